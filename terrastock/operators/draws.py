"""Weighted draws by alias tables: each draw costs two lookups a level, whatever the weights."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrastock.operators.shared import cut, number_rows

#: Slots of a table; also how many tables one of the level above stands for.
SLOTS = 4096


def alias_slots(weights: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """(share, other) of each slot: a draw that hits slot k takes k with its share, else ``other``. Slots beyond the weights
    have none of their own."""
    w = np.zeros(slots)
    w[: len(weights)] = weights
    share, other = w * slots / w.sum(), np.arange(slots)
    short, long = list(np.flatnonzero(share < 1)), list(np.flatnonzero(share >= 1))
    while short and long:
        s, g = short.pop(), long[-1]
        other[s] = g
        share[g] -= 1 - share[s]
        if share[g] < 1:
            short.append(long.pop())
    share[long] = 1.0
    for s in short:  # what rounding leaves over: its own if it has any, else the largest
        other[s], share[s] = (s, 1.0) if w[s] > 0 else (int(w.argmax()), 0.0)
    return share, other


def alias_levels(rows: DataFrame, key: str, weight: str, slots: int = SLOTS) -> tuple[DataFrame, list[DataFrame]]:
    """Numbered rows (key, place) and alias tables (bucket, slot, share, own, other), the level above all first.

    Rows are numbered by key and make buckets of ``slots``; the buckets' total weights make buckets again, until one is
    left. Rows whose weight is null or not above 0 are never drawn.
    """
    placed = number_rows(rows.where(F.col(weight) > 0).select(key, F.col(weight).cast("double").alias("w")), [key], "place")

    def tables(frame: pd.DataFrame) -> pd.DataFrame:
        own = frame.sort_values("place")
        bucket = int(own["place"].iloc[0]) // slots
        share, other = alias_slots(own["w"].to_numpy(), slots)
        base = bucket * slots
        return pd.DataFrame({"bucket": bucket, "slot": np.arange(slots), "share": share, "own": base + np.arange(slots), "other": base + other})

    level, out = placed.select("place", "w"), []
    while True:
        held = level.withColumn("bucket", F.floor(F.col("place") / slots))
        out.insert(0, cut(held.groupBy("bucket").applyInPandas(lambda b: tables(b[["place", "w"]]), "bucket long, slot long, share double, own long, other long")))
        sums = cut(held.groupBy("bucket").agg(F.sum("w").alias("w")).select(F.col("bucket").alias("place"), "w"))
        if sums.count() <= 1:
            return placed.select(key, "place"), out
        level = sums


def _uniform(seed: int, *columns: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11) / float(2**53)


def weighted_draws(rows: DataFrame, key: str, weight: str, draws: DataFrame, draw: str, seed: int = 0, slots: int = SLOTS) -> DataFrame:
    """(draw, key): for each draw, named by a key of its own, a row with a chance in proportion to its weight. The same draw
    and seed give the same row in every run. A table without weights gives none."""
    placed, levels = alias_levels(rows, key, weight, slots)
    at = draws.select(draw, F.lit(0).cast("long").alias("bucket"))
    for n, table in enumerate(levels):
        slot = F.pmod(F.xxhash64(F.lit(seed), F.lit(2 * n), F.col(draw)), F.lit(slots))
        met = at.withColumn("slot", slot).join(table, ["bucket", "slot"])
        taken = F.when(_uniform(seed, F.lit(2 * n + 1), F.col(draw)) < F.col("share"), F.col("own")).otherwise(F.col("other"))
        at = met.select(draw, taken.alias("bucket"))
    return at.join(placed.withColumnRenamed("place", "bucket"), "bucket").select(draw, key)
