"""Connected components of links between long ids, by alternating star contractions in Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrastock.llm.common import cut

#: Links that a task joins up by itself at a time; only cost depends on it.
CHUNK = 500_000


def _mark(edges: DataFrame) -> tuple:
    """Two numbers that tell sets of edges apart."""
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def least_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node reachable by these links) of every node but the least ones themselves."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, label = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        for end in (label[a], label[b]):  # the tree of either end is hung below the smaller root
            np.minimum.at(label, end, low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while not np.array_equal(up := label[label], label):
            label = up
        if np.array_equal(label, before):
            below = label < np.arange(len(nodes))
            return nodes[below], nodes[label[below]]


def _join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a task as stars, a chunk at a time: components stay, paths get short."""
    u, v = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def star() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in least_reachable(u, v)], names=["u", "v"])

    for b in batches:
        u, v = np.concatenate([u, b.column(0).to_numpy()]), np.concatenate([v, b.column(1).to_numpy()])
        if len(u) >= CHUNK:
            yield star()
            u, v = u[:0], v[:0]
    yield star()


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``links`` between different ones; a component is named by its least node.

    Each round joins up the links inside tasks, then lets every node hand its neighbours to its smallest one, first
    the larger neighbours, then the smaller ones. The rounds grow with the logarithm of the longest path that is
    left. A round's links replace the last one's in the shared folder.
    """
    edges = cut(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").mapInArrow(_join_up, "u long, v long"))
    before = _mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = cut(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), replaces=edges)
        edges, after = stars, _mark(stars)
        if after == before:
            break
        edges = cut(stars.mapInArrow(_join_up, "u long, v long"), replaces=stars)
        before = _mark(edges)
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
