"""Exact k-means over whole-number vectors, filtered by ball trees (operator 12).

Vectors become whole numbers, ``floor(scale * x)``, so that sums, means and distances are exact. Each task builds metric
trees over chunks of its vectors: a node stores its centre, a radius that holds all its vectors, how many there are,
their exact sum and the sum of their squared lengths. The trees are written to the shared folder once; every round reads
them. A ball goes to one centroid as a whole where the triangle inequality leaves no other: the distances from its
centre to any other and to this one differ by more than twice the radius. Otherwise its children are asked, and in the
end its leaf's vectors one by one, in exact arithmetic, ties to the smaller number.

A round sends ``k`` counts and sums from each task, added up by Spark; ``k`` centroids go to the driver and back. In
many dimensions without clusters few balls fit; then the rounds compare nearly all vectors, and results stay the same.

Defined results: rows whose vector is null, has another number of components, or holds null or non-finite components are
left out, as are those with a component so large that squared distances might not fit a long (``limit_of``); rows may
repeat and count each; rows with a null id are clustered but start no cluster; with fewer vectors than ``k`` there are
fewer clusters; an inertia beyond a long is null; extra columns are left out; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrastock.llm.common import cut

#: Vectors of one tree, and of a leaf; only cost depends on them.
CHUNK, LEAF = 4096, 32
#: Components below this have exact products and sums in double precision.
SMALL = 2**20
TREES = "ids array<long>, points binary, centres binary, radii binary, counts binary, sums binary, squares binary, ends binary"


def limit_of(components: int) -> int:
    """Components up to this, either way, give squared distances of at most 2**62, and fit 32 bits."""
    return isqrt(2**62 // max(1, components)) // 2


def whole_vectors(vectors: DataFrame, vec_id: str, embedding: str, components: int, scale: float) -> DataFrame:
    """(id, x array<long>) of the rows that take part."""
    x = F.col("x")
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{embedding}`").cast("array<double>").alias("x")).where(F.size(x) == components)
    most = limit_of(components) / scale
    fits = F.forall(x, lambda v: F.coalesce(v.between(-most, most), F.lit(False)))  # NaN counts as larger than all
    return rows.where(fits).select("id", F.transform(x, lambda v: F.floor(v * F.lit(float(scale)))).cast("array<long>").alias("x"))


def _build(p: np.ndarray) -> tuple[np.ndarray, ...]:
    """A tree over rows of ``p``: (order of rows, then for each node centre, radius, count, sum, sum of squares, and where
    its rows begin and end and which node follows its subtree), nodes in depth-first order."""
    order, nodes = np.arange(len(p)), []
    q = p.astype(np.float64)

    def add(lo: int, hi: int) -> None:
        rows = order[lo:hi]
        centre = q[rows].mean(axis=0)
        away = np.sqrt(((q[rows] - centre) ** 2).sum(axis=1))
        at = len(nodes)
        nodes.append([centre, away.max() * (1 + 1e-9), hi - lo, p[rows].sum(axis=0), lo, hi, 0])
        if hi - lo > LEAF and away.max() > 0:
            one = q[rows[away.argmax()]]
            from_one = ((q[rows] - one) ** 2).sum(axis=1)
            other = q[rows[from_one.argmax()]]
            side = np.argsort(q[rows] @ (other - one), kind="stable")
            order[lo:hi] = rows[side]
            add(lo, (lo + hi) // 2)
            add((lo + hi) // 2, hi)
        nodes[at][6] = len(nodes)

    add(0, len(p))
    centres, radii, counts, sums, *ends = zip(*nodes, strict=True)
    return order, np.array(centres), np.array(radii), np.array(counts), np.array(sums), np.array(list(zip(*ends, strict=True)))


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, points = [], []

    def tree() -> pa.RecordBatch:
        p = np.concatenate(points)
        keys = [k for part in ids for k in part]
        order, centres, radii, counts, sums, ends = _build(p)
        squares = (p[order] ** 2).sum(axis=1)
        squares = squares if np.abs(p).max(initial=0) < SMALL else squares.astype(object)  # sums may pass 64 bits
        wide = b"".join(int(squares[lo:hi].sum()).to_bytes(16, "little") for lo, hi, _ in ends)
        blobs = [p[order].astype(np.int32), centres, radii, counts.astype(np.int64), sums, wide, ends.astype(np.int64)]
        row = [[keys[i] for i in order.tolist()], *(b if isinstance(b, bytes) else b.tobytes() for b in blobs)]
        names = [c.split()[0] for c in TREES.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([row[0]], pa.list_(pa.int64())), *(pa.array([b], pa.binary()) for b in row[1:])], names=names)

    held = 0
    for b in batches:
        flat, n = b.column(1).flatten().to_numpy(), b.num_rows
        x, keys = flat.reshape(n, -1) if n else np.zeros((0, 1), np.int64), b.column(0).to_pylist()
        at = 0
        while at < n:
            take = min(n - at, CHUNK - held)
            ids.append(keys[at : at + take])
            points.append(x[at : at + take])
            held, at = held + take, at + take
            if held == CHUNK:
                yield tree()
                ids.clear()
                points.clear()
                held = 0
    if held:
        yield tree()


class _Tree:
    """A tree as it was stored."""

    def __init__(self, row: dict) -> None:
        self.ids = row["ids"]
        self.points = np.frombuffer(row["points"], np.int32).astype(np.int64).reshape(len(self.ids), -1)
        dims = self.points.shape[1]
        self.centres = np.frombuffer(row["centres"]).reshape(-1, dims)
        self.radii, self.counts = np.frombuffer(row["radii"]), np.frombuffer(row["counts"], np.int64)
        self.sums = np.frombuffer(row["sums"], np.int64).reshape(-1, dims)
        self.squares = [int.from_bytes(row["squares"][16 * i : 16 * i + 16], "little") for i in range(len(self.counts))]
        self.ends = np.frombuffer(row["ends"], np.int64).reshape(-1, 3)

    def settle(self, centroids: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
        """Whole balls as (node, centroid), and the rows that must be asked one by one."""
        away = np.sqrt(((self.centres[:, None, :] - centroids[None].astype(np.float64)) ** 2).sum(axis=2))
        near = away.argmin(axis=1)
        least = away[np.arange(len(away)), near]
        away[np.arange(len(away)), near] = np.inf
        gap = away.min(axis=1) - least
        sure = gap > 2 * self.radii + 1e-9 * (np.abs(self.centres).max() + np.abs(centroids).max() + 1) * centroids.shape[1]
        balls, single, node = [], [], 0
        while node < len(sure):
            lo, hi, after = self.ends[node]
            if sure[node]:
                balls.append((node, int(near[node])))
                node = int(after)
            elif after == node + 1:
                single.append(np.arange(lo, hi))
                node += 1
            else:
                node += 1
        return balls, np.concatenate(single) if single else np.zeros(0, np.int64)


def _squared(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, long."""
    if max(np.abs(points).max(initial=0), np.abs(centroids).max(initial=0)) < SMALL and points.shape[1] <= 1024:
        p, c = points.astype(np.float64), centroids.astype(np.float64)
        return ((p * p).sum(axis=1)[:, None] - 2 * (p @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    return np.stack([((points - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def _tree_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[_Tree]:
    for b in batches:
        for i in range(b.num_rows):
            yield _Tree(b.slice(i, 1).to_pylist()[0])


def _totals(centroids: np.ndarray):
    """(cluster, n, sums, distance as text) of each task's trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(centroids)
        n, sums, spread = np.zeros(k, np.int64), np.zeros(centroids.shape, np.int64), [0] * k
        norms = [sum(int(v) ** 2 for v in c) for c in centroids]
        for t in _tree_rows(batches):
            balls, single = t.settle(centroids)
            for node, c in balls:
                n[c] += t.counts[node]
                sums[c] += t.sums[node]
                dot = sum(int(a) * int(b) for a, b in zip(t.sums[node], centroids[c], strict=True))
                spread[c] += t.squares[node] - 2 * dot + int(t.counts[node]) * norms[c]
            d = _squared(t.points[single], centroids)
            to = d.argmin(axis=1)
            for c in range(k):
                mine = to == c
                n[c] += mine.sum()
                sums[c] += t.points[single[mine]].sum(axis=0)
                spread[c] += sum(map(int, d[mine, c])) if d.size and d.max() > 2**40 else int(d[mine, c].sum())
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(n), pa.array(sums.tolist(), pa.list_(pa.int64())), pa.array(list(map(str, spread)))], names=["cluster", "n", "sums", "spread"])

    return run


def totals(trees: DataFrame, centroids: np.ndarray) -> list:
    """For each centroid: rows, their sum and the sum of their squared distances, added up over tasks by Spark."""
    each = trees.mapInArrow(_totals(centroids), "cluster int, n long, sums array<long>, spread string")
    sums = F.array(*(F.sum(F.get("sums", F.lit(i))) for i in range(centroids.shape[1])))
    added = each.groupBy("cluster").agg(F.sum("n").alias("n"), sums.alias("sums"), F.sum(F.col("spread").cast("decimal(38,0)")).alias("spread"))
    return sorted((r["cluster"], int(r["n"]), [int(v) for v in r["sums"]], int(r["spread"])) for r in added.collect())


def cluster_vectors(
    vectors: DataFrame, k: int = 8, rounds: int = 10, components: int = 64, scale: float = 1024.0, seed: Column | None = None, vec_id: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid) of every vector that takes part.

    The first centroids are the ``k`` vectors with the least ``seed``, an expression of the column ``id``, ties by
    vector. Each round assigns all vectors and moves every centroid with vectors to the floor of their mean.
    """
    rows = whole_vectors(vectors, vec_id, embedding, components, scale)
    trees = cut(rows.mapInArrow(_trees, TREES))
    seed = F.sha2(F.concat(F.lit("3:"), F.col("id").cast("string")), 256) if seed is None else seed
    first = rows.where("id is not null").withColumn("__seed", seed).orderBy("__seed", "x").limit(k).select("x").collect()
    if not first:
        return rows.select(F.col("id").alias("vec_id"), *(F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid", "array<long>")))).where("false")
    centroids = np.array([r["x"] for r in first], np.int64)
    for _ in range(rounds):
        for c, n, sums, _ in totals(trees, centroids):
            if n:
                centroids[c] = [s // n for s in sums]
    spread = [s for *_, s in totals(trees, centroids)]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _tree_rows(batches):
            balls, single = t.settle(centroids)
            to, d = np.zeros(len(t.ids), np.int32), np.zeros(len(t.ids), np.int64)
            for node, c in balls:
                lo, hi, _ = t.ends[node]
                to[lo:hi], d[lo:hi] = c, _squared(t.points[lo:hi], centroids[c : c + 1])[:, 0]
            asked = _squared(t.points[single], centroids)
            to[single] = asked.argmin(axis=1)
            d[single] = asked.min(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(t.ids, pa.int64()), pa.array(to), pa.array(d)], names=["vec_id", "cluster", "distance"])

    found = trees.mapInArrow(assign, "vec_id long, cluster int, distance long")
    of = lambda values: F.element_at(F.array(*values), F.col("cluster") + 1)
    centroid = of([F.array(*(F.lit(int(v)).cast("long") for v in c)) for c in centroids])
    long = lambda v: F.lit(v if v < 2**63 else None).cast("long")
    return found.select("vec_id", "cluster", "distance", of([long(s) for s in spread]).alias("cluster_inertia"), long(sum(spread)).alias("inertia"), centroid.alias("centroid"))


def centroid_digest(centroid: Column) -> Column:
    return F.sha2(F.concat_ws(",", centroid.cast("array<string>")), 256)
