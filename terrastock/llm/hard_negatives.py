"""Hard negatives for anchors: near vectors of other labels, by inverted lists and their bounds (operator 11).

Vectors become whole numbers, ``floor(scale * x)``, and a score is their exact inner product with the anchor. An anchor's
positives are its best other rows of its label; for each positive, its negatives are the best rows of other labels whose
score lies in a window given by the positive's score.

Index. Centroids come from k-means over at most ``SAMPLE`` drawn vectors, about the root of the number of rows and at most
``LISTS`` of them. Every row joins the list of its nearest centroid, and each centroid keeps its radius, the largest
distance of its rows. A list is dealt in blocks of about ``BLOCK`` rows, so that a list of a third of all rows is many
tasks' work. Only centroids, radii and counts, at most ``LISTS`` of each, are sent to tasks whole.

Search. By Cauchy-Schwarz no row of a list scores above ``q.c + |q| r`` or below ``q.c - |q| r``. An anchor visits lists
by falling upper bound, in rounds of ``FIRST`` lists, then ``GROWTH`` times as many, and so on; a list whose bounds lie
outside the window is skipped, and the search ends where the bound falls strictly below the last score it needs.
A visit is a row with the anchor's vector, sent to the list's blocks, where it meets the block's rows in one product of
matrices; a block returns the first few for each window. So the work is that of a given query set against all rows, in
blocks; it is less where vectors form clusters.

Defined results: rows with a null id, null label, null or empty vector, or null or non-finite components take no part, nor
do rows whose squared length passes 2**55 or that have another length than the most common one; rows that share an id are
rows of their own, and an anchor of its own each; extra columns are left out; an empty table, or one without anchors,
gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrastock.llm.common import cut, release

LISTS, SAMPLE, STEPS = 1024, 32_768, 8
BLOCK, FIRST, GROWTH = 8192, 4, 64
#: Products that a task holds at a time.
CELLS = 1_000_000
LEAST, MOST = -(2**62), 2**62
WINDOWS = "array<struct<w int, lo long, hi long>>"


def whole_rows(vectors: DataFrame, vec_id: str, embedding: str, label: str, scale: float) -> DataFrame:
    """(uid, id, label, x array<long>) of the rows that take part, each with a number of its own."""
    names = {"id": F.col(f"`{vec_id}`").cast("long"), "label": F.col(f"`{label}`").cast("long"), "x": F.col(f"`{embedding}`").cast("array<double>")}
    rows = vectors.select(*(c.alias(n) for n, c in names.items())).where("id is not null and label is not null and size(x) > 0")
    most = 2.0**28 / scale
    rows = rows.where(F.forall("x", lambda v: F.coalesce(v.between(-most, most), F.lit(False))))  # NaN counts as larger than all
    rows = rows.withColumn("x", F.transform("x", lambda v: F.floor(v * F.lit(float(scale))).cast("long")))
    length2 = F.aggregate("x", F.lit(0).cast("double"), lambda a, v: a + v.cast("double") * v)
    return rows.where(length2 <= 2.0**55).withColumn("uid", F.monotonically_increasing_id())


def _lists(rows: DataFrame, n: int) -> np.ndarray:
    """Centroids of a drawn sample, by k-means."""
    share = min(1.0, 2 * SAMPLE / n)
    drawn = rows.where(F.pmod(F.xxhash64("uid", F.lit(1)), F.lit(1 << 30)) < int(share * (1 << 30))).orderBy(F.xxhash64("uid", F.lit(1))).limit(SAMPLE).select("x").toArrow()
    x = drawn.column("x").combine_chunks().flatten().to_numpy().reshape(len(drawn), -1).astype(np.float64)
    k = max(1, min(LISTS, int(n**0.5), len(x)))
    centroids = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(STEPS):
        to = _nearest(x, centroids)[0]
        n_of = np.bincount(to, minlength=k)
        sums = np.zeros_like(centroids)
        np.add.at(sums, to, x)
        centroids = np.where(n_of[:, None] > 0, sums / np.maximum(1, n_of)[:, None], centroids)
    return centroids


def _nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row and a distance not below the true one."""
    to = ((centroids * centroids).sum(axis=1) - 2 * (x @ centroids.T)).argmin(axis=1)
    away = np.sqrt(((x - centroids[to]) ** 2).sum(axis=1))
    return to, away * (1 + 1e-9)


def _placed(centroids: np.ndarray):
    """(list, away, uid, id, label, v binary) of rows (uid, id, label, x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(3).flatten().to_numpy().reshape(b.num_rows, centroids.shape[1])
            to, away = _nearest(x.astype(np.float64), centroids)
            v = [r.tobytes() for r in x.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(away), b.column(0), b.column(1), b.column(2), pa.array(v, pa.binary())], names=["list", "away", "uid", "id", "label", "v"])

    return run


class _Index:
    """What every task knows of the lists: centroids, radii, and in how many blocks each is dealt."""

    def __init__(self, centroids: np.ndarray, placed: DataFrame) -> None:
        self.centroids, self.radii = centroids, np.zeros(len(centroids))
        self.blocks = np.zeros(len(centroids), np.int64)
        for r in placed.groupBy("list").agg(F.count("*").alias("n"), F.max("away").alias("away")).collect():
            self.radii[r["list"]], self.blocks[r["list"]] = r["away"], -(-r["n"] // BLOCK)

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Upper and lower bounds of the scores of each list's rows, widened by what rounding may take."""
        mid = q @ self.centroids.T
        wide = np.sqrt((q * q).sum(axis=1))[:, None] * self.radii
        slack = 1e-9 * (np.abs(mid) + wide) + 1e-6
        return mid + wide + slack, mid - wide - slack


def _vectors(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int32).reshape(len(column), -1).astype(np.int64)


def _visits(index: _Index, first: int, last: int):
    """(list, block, uid, label, v, wanted) for each list that a query (uid, label, v, wanted) visits in this round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):  # bounds of so many queries at a time
                b = whole.slice(start, 1000)
                wanted = b.column(3)
                of = np.repeat(np.arange(b.num_rows), np.diff(wanted.offsets.to_numpy()))
                lo, hi = (wanted.flatten().field(c).to_numpy().astype(np.float64) for c in (1, 2))
                upper, lower = index.bounds(_vectors(b.column(2)).astype(np.float64))
                place = np.argsort(np.argsort(-upper, axis=1, kind="stable"), axis=1, kind="stable")
                fits = np.zeros(upper.shape, bool)
                np.logical_or.at(fits, of, (upper[of] >= lo[:, None]) & (lower[of] <= hi[:, None]))
                q, to = np.nonzero(fits & (place >= first) & (place < last) & (index.blocks > 0))
                blocks = index.blocks[to]
                q, to = np.repeat(q, blocks), np.repeat(to, blocks)
                block = np.arange(len(q)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                for i in range(0, len(q), 10_000):
                    some = slice(i, i + 10_000)
                    told = [b.column(c).take(pa.array(q[some])) for c in range(4)]
                    yield pa.RecordBatch.from_arrays([pa.array(to[some], pa.int32()), pa.array(block[some], pa.int32()), *told], names=["list", "block", "uid", "label", "v", "wanted"])

    return run


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products, by the fastest type that holds them and all that they are summed from."""
    most = float(np.sqrt((q.astype(float) ** 2).sum(axis=1).max(initial=0) * (x.astype(float) ** 2).sum(axis=1).max(initial=0)))
    for kind, exact in ((np.float32, 2.0**24), (np.float64, 2.0**53)):
        if most * 1.001 < exact:
            return (q.astype(kind) @ x.T.astype(kind)).astype(np.int64)
    return q @ x.T


def first_of_each(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the first ``k`` allowed cells of each row by falling score, ties to the earlier column."""
    if scores.shape[1] > k:
        masked = np.where(allowed, scores, LEAST)
        allowed = allowed & (scores >= np.partition(masked, -k, axis=1)[:, -k, None])
    r, c = np.nonzero(allowed)
    o = np.lexsort((-scores[r, c], r))
    r, c = r[o], c[o]
    rank = np.arange(len(r)) - np.searchsorted(r, r)
    return r[rank < k], c[rank < k]


def _meet(k: int, same: bool):
    """First ``k`` rows of each block for each window of each visit: (uid, w, id, hit, score), from rows (list, block,
    query, uid, id, label, v, wanted) sorted so that a block's own rows come first, by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, x = None, [], None

        def answer(visits: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            q, wanted = _vectors(visits.column(6)), visits.column(7)
            quid, label = visits.column(3).to_numpy(), visits.column(5).to_numpy()
            counts = np.diff(wanted.offsets.to_numpy())
            w, lo, hi = (wanted.flatten().field(c).to_numpy() for c in range(3))
            of = np.repeat(np.arange(len(q)), counts)
            step = max(1, CELLS // max(1, len(x)))
            for i in range(0, len(of), step):
                part = of[i : i + step]
                who = np.unique(part)
                s = _products(q[who], x)[np.searchsorted(who, part)]
                fits = (s >= lo[i : i + step, None]) & (s <= hi[i : i + step, None])
                alike = label[part][:, None] == own["label"]
                fits &= (alike & (quid[part][:, None] != own["uid"])) if same else ~alike
                r, c = first_of_each(s, fits, k)
                yield pa.RecordBatch.from_arrays([pa.array(quid[part][r]), pa.array(w[i : i + step][r], pa.int32()), pa.array(own["id"][c]), pa.array(own["uid"][c]), pa.array(s[r, c])], names=["uid", "w", "id", "hit", "score"])

        for b in batches:
            if not b.num_rows:
                continue
            lists, blocks, query = (b.column(i).to_numpy() for i in range(3))
            turn = np.flatnonzero((np.diff(lists, prepend=-1) != 0) | (np.diff(blocks, prepend=-1) != 0) | (np.diff(query, prepend=-1) != 0))
            for lo, hi in zip(turn.tolist(), [*turn[1:].tolist(), b.num_rows], strict=True):
                part, key = b.slice(lo, hi - lo), (lists[lo], blocks[lo])
                if key != now:
                    now, own, x = key, [], None
                if not query[lo]:
                    own.append(part)
                    continue
                if x is None and own:
                    x = np.concatenate([_vectors(p.column(6)) for p in own])
                    own = {n: np.concatenate([p.column(c).to_numpy() for p in own]) for n, c in (("uid", 3), ("id", 4), ("label", 5))}
                if x is not None:
                    yield from answer(part)

    return run


def _search(queries: DataFrame, placed: DataFrame, index: _Index, k: int, same: bool) -> DataFrame:
    """(uid, w, id, hit, score): the first ``k`` rows for each window ``w`` of each query (uid, label, v, wanted)."""
    lists = len(index.centroids)
    block = F.pmod(F.xxhash64("uid"), F.element_at(F.array(*(F.lit(int(max(1, n))).cast("long") for n in index.blocks)), F.col("list") + 1)).cast("int")
    members = placed.select("list", block.alias("block"), F.lit(0).alias("query"), "uid", "id", "label", "v", F.lit(None).cast(WINDOWS).alias("wanted"))
    rank = F.row_number().over(Window.partitionBy("uid", "w").orderBy(F.desc("score"), "id", "hit"))
    found, first, size = None, 0, FIRST
    while first < lists:
        todo = queries
        if found is not None:  # what beats or equals the last score that is needed
            last = found.groupBy("uid", "w").agg(F.min("score").alias("last"), F.count("*").alias("n")).where(F.col("n") == k).select("uid", "w", "last")
            each = queries.select("uid", "label", "v", F.explode("wanted").alias("y")).select("uid", "label", "v", "y.*").join(last, ["uid", "w"], "left")
            raised = each.withColumn("lo", F.greatest("lo", "last"))  # null counts for nothing
            todo = raised.groupBy("uid").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.collect_list(F.struct("w", "lo", "hi")).alias("wanted"))
        visits = todo.select("uid", "label", "v", F.col("wanted").cast(WINDOWS).alias("wanted")).mapInArrow(_visits(index, first, first + size), f"list int, block int, uid long, label long, v binary, wanted {WINDOWS}")
        visits = visits.select("list", "block", F.lit(1).alias("query"), "uid", F.lit(0).cast("long").alias("id"), "label", "v", "wanted")
        met = members.unionByName(visits).repartition("list", "block").sortWithinPartitions("list", "block", "query", "id")
        hits = met.mapInArrow(_meet(k, same), "uid long, w int, id long, hit long, score long")
        hits = hits if found is None else hits.unionByName(found)
        before, found = found, cut(hits.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank"))
        if before is not None:
            release(before)
        first, size = first + size, size * GROWTH
    return found


def mine_hard_negatives(
    vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256.0,
    vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchors`` says by the column ``id`` which rows are anchors. A negative's score is from ``low`` to ``high`` hundredths
    of its positive's score.
    """
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = whole_rows(vectors, vec_id, embedding, label, scale)
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").collect()
    if not sizes:
        return vectors.sparkSession.createDataFrame([], out)
    rows = cut(rows.where(F.size("x") == sizes[0]["d"]))
    centroids = _lists(rows, sizes[0]["count"])
    placed = cut(rows.select("uid", "id", "label", "x").mapInArrow(_placed(centroids), "list int, away double, uid long, id long, label long, v binary"))
    release(rows)
    index = _Index(centroids, placed)
    asked = placed.where(anchors).select("uid", "id", "label", "v")
    all_of = F.array(F.struct(F.lit(0).alias("w"), F.lit(LEAST).alias("lo"), F.lit(MOST).alias("hi")))
    liked = _search(asked.withColumn("wanted", all_of), placed, index, positives, same=True)
    # equal scores have one window between them
    hundredth = lambda c, up: F.expr(f"({c} + {99 if up else 0}) div 100")
    windows = liked.where("score >= 0").withColumns({"__lo": F.col("score") * low, "__hi": F.col("score") * high}).select("uid", "score", hundredth("__lo", True).alias("lo"), hundredth("__hi", False).alias("hi")).distinct()
    number = F.row_number().over(Window.partitionBy("uid").orderBy("score")).cast("int")
    windows = cut(windows.withColumn("w", number))
    queries = asked.join(windows.groupBy("uid").agg(F.collect_list(F.struct("w", "lo", "hi")).alias("wanted")), "uid").select("uid", "label", "v", "wanted")
    disliked = _search(queries, placed, index, negatives, same=False)
    rank = F.row_number().over(Window.partitionBy("uid", "hit").orderBy(F.desc("negative_score"), "negative_id", "__hit")).cast("int")
    pairs = liked.drop("w").join(windows.select("uid", "score", "w"), ["uid", "score"]).select("uid", "w", "hit", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    met = pairs.join(disliked.select("uid", "w", F.col("id").alias("negative_id"), F.col("hit").alias("__hit"), F.col("score").alias("negative_score")), ["uid", "w"])
    return met.withColumn("rank", rank).join(asked.select("uid", F.col("id").alias("anchor_id")), "uid").select(*(c.split()[0] for c in out.split(", ")))
