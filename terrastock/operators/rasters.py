"""Rasters as tables of occupied cells: connected parts, their sizes and boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrastock.operators.shared import cut, release


def runs_of_cells(cells: DataFrame, image: str = "image", row: str = "row", col: str = "col") -> DataFrame:
    """(image, row, first, last): runs of neighbouring occupied cells along rows; cells may repeat."""
    own = cells.select(image, row, col).distinct()
    island = F.col(col) - F.row_number().over(Window.partitionBy(image, row).orderBy(col))
    return own.withColumn("__i", island).groupBy(image, row, "__i").agg(F.min(col).alias("first"), F.max(col).alias("last")).drop("__i")


def least_labels(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label) of (node): the least node that links (a, b) lead to, itself included.

    Each round every node takes the least label of its neighbours and then the label of its label, so the rounds grow
    with the logarithm of the longest way; a round's table replaces the last one's in the shared folder.
    """
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    label = cut(nodes.select("node", F.col("node").alias("label"), F.lit(True).alias("moved")))
    while True:
        heard = both.join(label.select(F.col("node").alias("b"), F.col("label").alias("l")), "b").groupBy("a").agg(F.min("l").alias("near"))
        nearer = label.join(heard.withColumnRenamed("a", "node"), "node", "left").select("node", F.least("label", "near").alias("to"), F.col("label").alias("old"))
        # a node hands what it has heard to the node that its label names, too
        told = nearer.where("to < old").groupBy(F.col("old").alias("node")).agg(F.min("to").alias("told"))
        known = nearer.join(told, "node", "left").select("node", F.least("to", "told").alias("to"), "old")
        jump = known.select(F.col("node").alias("to"), F.col("to").alias("further"))
        after = known.join(jump, "to", "left").select("node", F.least("to", "further").alias("label"), (F.least("to", "further") < F.col("old")).alias("moved"))
        label, before = cut(after), label
        release(before)
        if label.where("moved").isEmpty():
            release(both)
            return label.select("node", "label")


def connected_parts(cells: DataFrame, image: str = "image", row: str = "row", col: str = "col", corners: bool = True) -> DataFrame:
    """(image, part, cells, min_row, min_col, max_row, max_col): parts of occupied cells that touch by sides, or by corners
    too. A part is named by its first run, (row, first), in reading order.

    Cells become runs, a run meets the runs above that it touches, and labels travel over runs, not cells.
    """
    runs = cut(runs_of_cells(cells, image, row, col).withColumn("node", F.struct(F.col(image).alias("image"), F.col(row).alias("row"), F.col("first").alias("first"))))
    reach = 1 if corners else 0
    above = runs.select(image, (F.col(row) + 1).alias(row), F.col("first").alias("f2"), F.col("last").alias("l2"), F.col("node").alias("b"))
    # runs of a row don't overlap, so that a run touches few runs above it besides those that lie in it whole
    links = runs.join(above, [image, row]).where((F.col("f2") <= F.col("last") + reach) & (F.col("l2") >= F.col("first") - reach)).select(F.col("node").alias("a"), "b")
    labels = least_labels(runs.select("node"), links)
    met = runs.join(labels, "node").groupBy(image, F.struct("label.row", "label.first").alias("part"))
    return met.agg(F.sum(F.col("last") - F.col("first") + 1).alias("cells"), F.min(row).alias("min_row"), F.min("first").alias("min_col"), F.max(row).alias("max_row"), F.max("last").alias("max_col"))


def largest_parts(cells: DataFrame, image: str = "image", row: str = "row", col: str = "col", corners: bool = True) -> DataFrame:
    """Of each image the part with most cells, ties to the first in reading order."""
    parts = connected_parts(cells, image, row, col, corners)
    values = [c for c in parts.columns if c != image]
    return parts.groupBy(image).agg(F.min_by(F.struct(*values), F.struct(-F.col("cells"), F.col("part"))).alias("__v")).select(image, "__v.*")
