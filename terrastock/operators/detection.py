"""Post-processing of detected boxes: (image, box_id, x1, y1, x2, y2, score, label)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Predictor(Protocol):
    """A model from outside: predictions (image, prediction, probability) for batches of images, loaded once a task."""

    def predict(self, images: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]: ...


def predict(images: DataFrame, make: Callable[[], Predictor], schema: str = "image string, prediction string, probability double") -> DataFrame:
    return images.mapInPandas(lambda batches: make().predict(batches), schema)


def box_area(p: str = "") -> Column:
    return (F.col(f"{p}x2") - F.col(f"{p}x1")) * (F.col(f"{p}y2") - F.col(f"{p}y1"))


def overlap_area(p: str, q: str) -> Column:
    side = lambda k: F.greatest(F.least(f"{p}{k}2", f"{q}{k}2") - F.greatest(f"{p}{k}1", f"{q}{k}1"), F.lit(0.0))
    return side("x") * side("y")


def clean_boxes(boxes: DataFrame, threshold: float) -> DataFrame:
    """Boxes above a score that are at least one wide and high."""
    return boxes.where((F.col("score") > threshold) & (F.col("x2") - F.col("x1") >= 1) & (F.col("y2") - F.col("y1") >= 1))


def presence(images: DataFrame, boxes: DataFrame, threshold: float = 0.35) -> DataFrame:
    """(image, prediction): 1 where a box scores above the threshold, 0 for every other image asked for."""
    seen = boxes.groupBy("image").agg(F.max("score").alias("__s"))
    return images.select("image").distinct().join(seen, "image", "left").select("image", F.when(F.col("__s") > threshold, 1).otherwise(0).alias("prediction"))


def non_maximum_suppression(boxes: DataFrame, iou: float = 0.2) -> DataFrame:
    """Greedy by falling score within an image and label: a box goes if it overlaps a kept one by more than ``iou``."""

    def keep(rows: pd.DataFrame) -> pd.DataFrame:
        a = rows[["x1", "y1", "x2", "y2"]].to_numpy()
        area, chosen = (a[:, 2] - a[:, 0]) * (a[:, 3] - a[:, 1]), []
        for start, end in _groups(rows, ["image", "label"]):
            left = np.arange(start, end)
            while len(left):
                i, rest = left[0], left[1:]
                chosen.append(i)
                w = (np.minimum(a[rest, 2], a[i, 2]) - np.maximum(a[rest, 0], a[i, 0])).clip(0)
                h = (np.minimum(a[rest, 3], a[i, 3]) - np.maximum(a[rest, 1], a[i, 1])).clip(0)
                both = w * h
                left = rest[both / (area[i] + area[rest] - both) <= iou]
        return rows.iloc[chosen]

    return _whole_groups(boxes, ["image", "label"], [F.desc("score"), F.col("box_id")], keep, boxes.schema)


def _groups(rows: pd.DataFrame, keys: list[str]) -> list[tuple[int, int]]:
    """Where each group of sorted rows starts and ends."""
    new = np.zeros(len(rows), bool)
    for k in keys:
        v = rows[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    starts = np.flatnonzero(new | (np.arange(len(rows)) == 0)).tolist()
    return list(zip(starts, [*starts[1:], len(rows)], strict=True))


def _whole_groups(df: DataFrame, keys: list[str], order: list[Column], f: Callable[[pd.DataFrame], pd.DataFrame], schema) -> DataFrame:
    """``f`` on many whole, sorted groups at a time: one shuffle, and no call for each small group."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for b in batches:
            held = b if held is None else pd.concat([held, b], ignore_index=True)
            if len(held) and (last := _groups(held, keys)[-1][0]):
                yield f(held.iloc[:last].reset_index(drop=True))
                held = held.iloc[last:].reset_index(drop=True)
        if held is not None and len(held):
            yield f(held)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def overlapping_boxes(boxes: DataFrame, share: float = 0.75) -> DataFrame:
    """(image, box_id, other_id): boxes more than ``share`` of whose area lies in another box of the image."""
    p = boxes.select("image", F.col("box_id"), *(F.col(c).alias(f"p_{c}") for c in ("x1", "y1", "x2", "y2")))
    q = boxes.select("image", F.col("box_id").alias("other_id"), *(F.col(c).alias(f"q_{c}") for c in ("x1", "y1", "x2", "y2")))
    return p.join(q, "image").where(F.col("box_id") != F.col("other_id")).where(overlap_area("p_", "q_") > share * box_area("p_")).select("image", "box_id", "other_id")


def floor_counts(boxes: DataFrame, height: float) -> DataFrame:
    """(image, floors): floors shown by the boxes of each image, ``height`` high; see ``_floors`` for one image."""

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        table = rows[["x1", "y1", "x2", "y2", "score"]].to_numpy(float)
        found = [(rows["image"].iat[a], _floors(table[a:b], height)) for a, b in _groups(rows, ["image"])]
        return pd.DataFrame(found, columns=["image", "floors"])

    schema = T.StructType([boxes.schema["image"], T.StructField("floors", T.LongType())])
    return _whole_groups(boxes, ["image"], [F.desc("score"), F.col("box_id")], count, schema)


def _shares(b: np.ndarray) -> np.ndarray:
    """At [p, q] the share of box p that lies in box q; 0 where either has no area."""
    w = (np.minimum(b[:, None, 2], b[None, :, 2]) - np.maximum(b[:, None, 0], b[None, :, 0])).clip(0)
    h = (np.minimum(b[:, None, 3], b[None, :, 3]) - np.maximum(b[:, None, 1], b[None, :, 1])).clip(0)
    area = (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1])
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where((area[:, None] != 0) & (area[None, :] != 0), w * h / area[:, None], 0.0)


def _joint_area(b: np.ndarray, left: float, right: float, height: float) -> tuple[float, float]:
    """The area that boxes cover together, and how much of it lies between two columns of the image.

    Columns are swept from one side or edge of a box to the next; over each, the rows that boxes hold are united in order.
    """
    b = b[np.lexsort((b[:, 3], b[:, 1]))]
    xs, whole, middle = np.unique(np.r_[b[:, [0, 2]].ravel(), left, right]), 0.0, 0.0
    for x, after in zip(xs, xs[1:], strict=False):
        y0, y1 = b[(b[:, 0] <= x) & (x < b[:, 2])][:, [1, 3]].T
        if not len(y0):
            continue
        reach = np.maximum.accumulate(y1)
        from_ = np.maximum(y0, np.r_[-np.inf, reach[:-1]])
        whole += (after - x) * np.maximum(0, reach - from_).sum()
        if left <= x < right:
            middle += (after - x) * np.maximum(0, np.minimum(reach, height) - np.maximum(from_, 0)).sum()
    return whole, middle


def _floors(rows: np.ndarray, height: float) -> int:
    """Floors from rows (x1, y1, x2, y2, score), best first; 0 without boxes.

    The threshold starts at 0.2, falls in steps of 0.02 while nothing is found and rises in steps of 0.1 while a box
    holds over three quarters of more than two others. Of boxes that lie mostly in one, all but the first go. Boxes
    that are steeply above each other (1.3) make stacks; if these, or the columns over the boxes, are all one, the
    column counts, else the larger of the two stacks that lie most in the image's middle.
    """
    above = lambda t: rows[rows[:, 4] > t, :4]
    own, step = above(0.2), 1
    while True:
        inner = _shares(own) > 0.75
        crowded = len(own) > 0 and (inner.sum(0) > 3).any()
        level = 0.2 + 0.1 * step if crowded else 0.2 - 0.02 * step
        if (len(own) and not crowded) or level > 1 or level < 1e-9:
            break
        own, step = above(level), step + 1
    if not len(own):
        return 0
    later = np.cumsum(inner, axis=0) > 1
    own = own[~(inner & later).any(1)]
    wide = np.column_stack([0.9 * own[:, 0], np.zeros(len(own)), 1.1 * own[:, 2], np.full(len(own), height - 1)])
    columns = np.unique(_shares(wide).T > 0.1, axis=0)
    cx, cy = (own[:, 0] + own[:, 2]) / 2, (own[:, 1] + own[:, 3]) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        steep = np.abs(cy[:, None] - cy) / np.abs(cx[:, None] - cx) > 1.3
    stacks = np.unique(steep | np.eye(len(own), dtype=bool), axis=0)[::-1]
    if len(columns) == 1 or len(stacks) == 1:
        return int(columns[-1].sum())
    shares = np.array([part / whole if whole else 0.0 for whole, part in (_joint_area(own[s], height / 5, 4 * height / 5, height) for s in stacks)])
    best = [k for k in np.argsort(-shares, kind="stable")[:2] if shares[k] > 0.1]
    return int(max((stacks[k].sum() for k in best), default=stacks[0].sum()))


def best_box(boxes: DataFrame, word: str, pad: float) -> DataFrame:
    """(image, x1, y1, x2, y2): the likeliest box whose label contains a word, padded."""
    own = boxes.where(F.contains(F.lower("label"), F.lit(word.lower()))).groupBy("image").agg(F.max_by(F.struct("x1", "y1", "x2", "y2"), F.struct("score", -F.col("box_id"))).alias("b"))
    return own.select("image", (F.col("b.x1") - pad).alias("x1"), (F.col("b.y1") - pad).alias("y1"), (F.col("b.x2") + pad).alias("x2"), (F.col("b.y2") + pad).alias("y2"))


def images_with_all(boxes: DataFrame, labels: list[str]) -> DataFrame:
    """(image) of images that have boxes of every label."""
    return boxes.where(F.col("label").isin(labels)).groupBy("image").agg(F.count_distinct("label").alias("n")).where(F.col("n") == len(set(labels))).select("image")


def top_k(boxes: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("image").orderBy(F.desc("score"), "box_id")
    return boxes.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def letter_box(width: Column, height: Column, size: int) -> Column:
    """(new_w, new_h, pad_w, pad_h) of an image fitted into a square, its longer side whole."""
    wide = width > height
    new_w = F.when(wide, size).otherwise(F.floor(size / height * width)).cast("long")
    new_h = F.when(wide, F.floor(size / width * height)).otherwise(size).cast("long")
    return F.struct(new_w.alias("new_w"), new_h.alias("new_h"), (size - new_w).alias("pad_w"), (size - new_h).alias("pad_h"))


def undo_letter_box(boxes: DataFrame, width: str, height: str, size: int) -> DataFrame:
    """Boxes in pixels of the fitted image put back into those of the image as it was."""
    fit = letter_box(F.col(width), F.col(height), size)
    back = {f"x{k}": F.col(f"x{k}") / (fit["new_w"] / F.col(width)) for k in (1, 2)} | {f"y{k}": F.col(f"y{k}") / (fit["new_h"] / F.col(height)) for k in (1, 2)}
    return boxes.withColumns(back)


def decode_boxes(rows: DataFrame, width: float, height: float) -> DataFrame:
    """Boxes from anchors (ax1, ay1, ax2, ay2) and offsets (dx, dy, dw, dh) in anchor sizes, clipped to the image."""
    out = {}
    for k, side, last in (("x", "w", width), ("y", "h", height)):
        long = F.col(f"a{k}2") - F.col(f"a{k}1")
        centre = (F.col(f"a{k}1") + F.col(f"a{k}2")) / 2 + F.col(f"d{k}") * long
        half = F.exp(f"d{side}") * long / 2
        out |= {f"{k}1": F.greatest(centre - half, F.lit(0.0)), f"{k}2": F.least(centre + half, F.lit(last - 1.0))}
    return rows.withColumns(out)


def class_over_scales(scores: DataFrame, key: str) -> DataFrame:
    """(key, label, score): the class whose score, averaged over scales, is largest; ties go to the smaller label."""
    mean = scores.groupBy(key, "label").agg(F.avg("score").alias("score"))
    return mean.groupBy(key).agg(F.max_by("label", F.struct("score", -F.col("label"))).alias("label"), F.max("score").alias("score"))


def in_area_range(annotations: DataFrame, least: float, most: float, crowd: bool = False) -> DataFrame:
    """Annotations (area, crowd, ...) of an area in a range, of groups or of single things."""
    return annotations.where(F.col("area").between(least, most) & (F.col("crowd") == crowd))


def of_categories(annotations: DataFrame, categories: DataFrame, names: list[str] | None = None, supercategories: list[str] | None = None, ids: list[int] | None = None) -> DataFrame:
    """Annotations (category_id, ...) of categories (id, name, supercategory) that are in every list given."""
    kept = categories
    for column, values in (("name", names), ("supercategory", supercategories), ("id", ids)):
        kept = kept if values is None else kept.where(F.col(column).isin(values))
    return annotations.join(kept.select(F.col("id").alias("category_id")), "category_id", "left_semi")
