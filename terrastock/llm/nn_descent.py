"""Approximate nearest neighbours by largest inner product: NN-descent and greedy graph search (operator 4).

Index. Vectors get one more component that makes all norms equal, so that inner products order as distances do. The
first graph holds the best neighbours inside the leaves of a few trees: each tree splits by the sides of hyperplanes
between drawn vectors, and range partitions of (leaf, hash) are cut into pieces of bounded size, so no leaf is too
large for a task. Each round joins every node with its neighbours and (a bounded, hashed choice of) those it is a
neighbour of, fetches each such member's vector by a join on its id, and compares the members of a node's list with
each other: neighbours of neighbours. What beats a member's worst neighbour is sent to it. Rounds end when few
neighbours change. A round moves at most ``K + REVERSE`` vectors for each node, whatever their number.

Search. A query keeps a beam of its best nodes, at first ``ENTRIES`` drawn ones and, if it is a node itself, those its
own node leads to. Each round joins the best nodes not yet followed with the graph, fetches the vectors of the nodes
they lead to, and merges. The last beam is scored again on the original vectors in double precision.

Vectors travel with 8 bits a component. Every vector is indexed, and the descent runs at every size. Recall at 20 of
the query on this repository's tables is at least 0.9 (see the tests).

Defined results: rows whose vector is null, zero, of a length other than the most common one, or holds null or
non-finite components take no part, nor do rows with a null id; of rows that share an id, the least vector counts;
ties go to the smaller id; extra columns are left out; an empty table, or one without queries, gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrastock.llm.common import cut

K, REVERSE = 48, 32
#: Trees, and about how many vectors a leaf has; a tree has 2**LEAST_SPLITS leaves or more.
TREES, LEAF, LEAST_SPLITS = 4, 1024, 3
#: Drawn vectors: those that hyperplanes lie between, and those that every search looks at first.
DRAWN, ENTRIES = 2048, 64
EDGES = "node long, nid long, sim float, mark int"


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(id, x array<double>) of the rows that take part."""
    x = F.col(embedding).cast("array<double>")
    rows = vectors.where(F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), x.alias("x")).where(F.col("x").isNotNull())
    rows = rows.where(F.coalesce(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False)) & F.exists("x", lambda v: v != 0))
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("x") == (sizes["d"] if sizes else 0)).groupBy("id").agg(F.min("x").alias("x"))


def packed(x: np.ndarray, more: np.ndarray) -> list[bytes]:
    """Each vector as its scale, one more component, and 8 bits a component."""
    scale = np.abs(x).max(axis=1, initial=0) / 127
    ints = np.rint(x / np.where(scale > 0, scale, 1)[:, None]).astype(np.int8)
    head = np.stack([scale, more], axis=1).astype(np.float32)
    return [h.tobytes() + r.tobytes() for h, r in zip(head, ints, strict=True)]


def unpacked(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The vectors of ``packed`` as rows; the one more component comes last."""
    rows = column.to_pylist()
    raw = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)
    head = np.ascontiguousarray(raw[:, :8]).view(np.float32)
    return np.concatenate([raw[:, 8:].view(np.int8) * head[:, :1], head[:, 1:]], axis=1)


def _points(rows: DataFrame) -> DataFrame:
    """(id, v binary, q binary): the vector with the component that evens norms out, and with zero there instead."""
    top = rows.agg(F.max(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))).first()[0] or 0.0

    def pack(batches):
        for b in batches:
            x = np.array(b.column(1).to_pylist(), np.float64).reshape(b.num_rows, -1)
            more = np.sqrt(np.maximum(0, top - (x * x).sum(axis=1)))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(packed(x, m), pa.binary()) for m in (more, np.zeros_like(more)))], names=["id", "v", "q"])

    return rows.select("id", "x").mapInArrow(pack, "id long, v binary, q binary")


def _top(node: np.ndarray, nid: np.ndarray, sim: np.ndarray, mark: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The ``k`` best different neighbours of each node; of equal ones the smallest mark stays."""
    o = np.lexsort((mark, nid, node))
    node, nid, sim, mark = node[o], nid[o], sim[o], mark[o]
    new = np.ones(len(node), bool)
    new[1:] = (node[1:] != node[:-1]) | (nid[1:] != nid[:-1])
    node, nid, sim, mark = node[new], nid[new], sim[new], mark[new]
    o = np.lexsort((nid, -sim, node))
    node, nid, sim, mark = node[o], nid[o], sim[o], mark[o]
    starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.zeros(0, int)
    rank = np.arange(len(node)) - np.repeat(starts, np.diff(np.append(starts, len(node))))
    keep = rank < k
    return node[keep], nid[keep], sim[keep], mark[keep]


def _edges(node, nid, sim, mark) -> dict[str, pa.Array]:
    return {"node": pa.array(node, pa.int64()), "nid": pa.array(nid, pa.int64()), "sim": pa.array(sim, pa.float32()), "mark": pa.array(mark, pa.int32())}


def _best(edges: DataFrame, k: int) -> DataFrame:
    """The ``k`` best edges of each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, t) for t in (np.int64, np.int64, np.float32, np.int32)]
        for b in batches:
            held = [np.concatenate([h, b.column(i).to_numpy()]) for i, h in enumerate(held)]
            if not len(held[0]):
                continue
            if last := int(np.searchsorted(held[0], held[0][-1])):
                yield pa.RecordBatch.from_pydict(_edges(*_top(*(h[:last] for h in held), k)))
                held = [h[last:] for h in held]
            if len(held[0]) > 50 * k:
                held = list(_top(*held, k))
        if len(held[0]):
            yield pa.RecordBatch.from_pydict(_edges(*_top(*held, k)))

    return edges.repartition("node").sortWithinPartitions("node").mapInArrow(run, EDGES)


def _drawn(points: DataFrame, n: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of up to ``most`` nodes, drawn by a hash of the id."""
    share = min(1.0, 2 * most / max(1, n))
    rows = points.where(F.pmod(F.xxhash64("id", F.lit(-1)), F.lit(1 << 30)) < int(share * (1 << 30)))
    table = rows.orderBy(F.xxhash64("id", F.lit(-1)), "id").limit(most).select("id", "v").toArrow()
    return table.column("id").to_numpy(), unpacked(table.column("v")) if len(table) else np.zeros((0, 1), np.float32)


def _leaf_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Best neighbours of each vector inside its leaf, from rows (leaf, id, v) sorted by leaf; a large leaf comes in pieces."""
    leaf, ids, v = np.zeros(0, np.int64), np.zeros(0, np.int64), None

    def compare(ids: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
        if k := min(K // 2, len(ids) - 1):
            s = v @ v.T
            np.fill_diagonal(s, -np.inf)
            at = np.argpartition(-s, k - 1, axis=1)[:, :k]
            yield pa.RecordBatch.from_pydict(_edges(np.repeat(ids, k), ids[at].ravel(), np.take_along_axis(s, at, 1).ravel(), np.ones(at.size)))

    for b in batches:
        if not b.num_rows:
            continue
        x = unpacked(b.column(2))
        leaf, ids = np.concatenate([leaf, b.column(0).to_numpy()]), np.concatenate([ids, b.column(1).to_numpy()])
        v = x if v is None else np.concatenate([v, x])
        at, last = 0, int(np.searchsorted(leaf, leaf[-1]))
        while at < last or len(leaf) - at > 2 * LEAF:
            end = min(at + (LEAF if leaf[min(at + 2 * LEAF, len(leaf) - 1)] == leaf[at] else 2 * LEAF), int(np.searchsorted(leaf, leaf[at], side="right")))
            yield from compare(ids[at:end], v[at:end])
            at = end
        leaf, ids, v = leaf[at:], ids[at:], v[at:]
    if len(leaf):
        yield from compare(ids, v)


def _first_graph(points: DataFrame, n: int) -> DataFrame:
    """Edges inside the leaves of ``TREES`` trees."""
    splits = max(LEAST_SPLITS, (-(-n // LEAF) - 1).bit_length())
    _, drawn = _drawn(points, n, DRAWN)
    drawn = drawn if len(drawn) else np.zeros((1, 1), np.float32)  # an empty table
    rng = np.random.default_rng(0)
    planes = [drawn[rng.integers(0, len(drawn), splits)] - drawn[rng.integers(0, len(drawn), splits)] for _ in range(TREES)]

    def leaves(batches):
        for b in batches:
            if b.num_rows:
                x = unpacked(b.column(1))
                for tree, p in enumerate(planes):
                    code = ((x @ p.T) > 0) @ (1 << np.arange(splits, dtype=np.int64)) + (tree << 40)
                    yield pa.RecordBatch.from_arrays([pa.array(code, pa.int64()), b.column(0), b.column(1)], names=["leaf", "id", "v"])

    place = F.xxhash64("id", F.lit(0))
    dealt = points.select("id", "v").mapInArrow(leaves, "leaf long, id long, v binary").withColumn("place", place)
    return dealt.repartitionByRange("leaf", "place").sortWithinPartitions("leaf", "place").select("leaf", "id", "v").mapInArrow(_leaf_neighbours, EDGES)


def _local_join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare the members of each centre's list, from rows (centre, member, fresh, worst, v) sorted by centre.

    Only pairs with a fresh member are new. What beats a member's worst neighbour goes to it.
    """
    held: list[np.ndarray] = [np.zeros(0, t) for t in (np.int64, np.int64, np.float32, np.int32)]

    def compare(rows: pa.RecordBatch) -> None:
        centre, member, fresh, worst = (rows.column(i).to_numpy() for i in range(4))
        o = np.lexsort((-fresh, member, centre))
        new = np.ones(len(o), bool)
        new[1:] = (centre[o][1:] != centre[o][:-1]) | (member[o][1:] != member[o][:-1])
        o = o[new]
        centre, member, fresh, worst = centre[o], member[o], fresh[o] > 0, worst[o]
        v = unpacked(rows.column(4))[o]
        starts = np.flatnonzero(np.concatenate([[True], centre[1:] != centre[:-1]]))
        sizes = np.diff(np.append(starts, len(centre)))
        width = int(sizes.max())
        for g in range(0, len(starts), 64):
            place = starts[g : g + 64, None] + np.arange(width)
            real = np.arange(width) < sizes[g : g + 64, None]
            place = np.where(real, place, starts[g : g + 64, None])
            x, f = v[place], fresh[place] & real
            sim = x @ x.transpose(0, 2, 1)
            ok = (f[:, :, None] | f[:, None, :]) & real[:, :, None] & real[:, None, :] & (sim > worst[place][:, :, None])
            ok[:, np.arange(width), np.arange(width)] = False
            c, i, j = np.nonzero(ok)
            m = member[place]
            for k, found in enumerate((m[c, i], m[c, j], sim[c, i, j], np.ones(len(c), np.int32))):
                held[k] = np.concatenate([held[k], found])

    rest: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        rest.append(b)
        rows = pa.Table.from_batches(rest).combine_chunks().to_batches()[0]
        centre = rows.column(0).to_numpy()
        if last := int(np.searchsorted(centre, centre[-1])):
            compare(rows.slice(0, last))
        rest = [rows.slice(last)]
        if len(held[0]) > 1_000_000:
            yield pa.RecordBatch.from_pydict(_edges(*_top(*held, K)))
            held[:] = [h[:0] for h in held]
    if rest:
        compare(rest[0])
    yield pa.RecordBatch.from_pydict(_edges(*_top(*held, K)))


def _reverse(graph: DataFrame, order: Column) -> DataFrame:
    """Up to ``REVERSE`` edges that lead to each node, the first ones in ``order``."""
    place = F.row_number().over(Window.partitionBy("nid").orderBy(order, "node"))
    return graph.withColumn("r", place).where(F.col("r") <= REVERSE)


def build_graph(points: DataFrame, n: int, rounds: int = 12, settled: float = 0.06) -> DataFrame:
    """Edges (node, nid, sim, mark) of the neighbour graph, up to ``K`` for each node.

    At least one round of descent runs, and the last is the one that changes less than the share ``settled`` of all edges.
    """
    graph = cut(_best(_first_graph(points, n), K))
    for step in range(rounds):
        back = _reverse(graph, F.xxhash64("node", F.lit(step)))
        lists = graph.select(F.col("node").alias("centre"), F.col("nid").alias("member"), F.col("mark").alias("fresh")).unionByName(
            back.select(F.col("nid").alias("centre"), F.col("node").alias("member"), F.col("mark").alias("fresh"))
        )
        low = F.lit(float("-inf")).cast("float")
        worst = graph.groupBy(F.col("node").alias("id")).agg(F.when(F.count("*") >= K, F.min("sim")).otherwise(low).alias("worst"))
        known = points.select(F.col("id"), "v").join(worst, "id", "left").select(F.col("id").alias("member"), F.coalesce("worst", low).alias("worst"), "v")
        fetched = lists.join(known, "member").select("centre", "member", "fresh", "worst", "v")
        news = fetched.repartition("centre").sortWithinPartitions("centre").mapInArrow(_local_join, EDGES)
        graph = cut(_best(graph.withColumn("mark", F.lit(0)).unionByName(news), K), replaces=graph)
        if graph.where("mark = 1").count() < settled * n * K:
            break
    return graph


def _merged(beam: int, follow: int):
    """A task's step of the search, over rows (q, m, sim, mark, v) sorted by query.

    Mark -1 is the query's own vector, -2 a node to be scored; others are of its beam, as in ``search_graph``.
    """

    def settle(rows: pa.RecordBatch) -> pa.RecordBatch:
        q, m, sim, mark = (rows.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        own, ask = np.flatnonzero(mark == -1), np.flatnonzero(mark == -2)
        keep = [np.flatnonzero(mark >= 0)]
        sim, mark = sim.astype(np.float32), np.where(mark == 1, 0, mark)
        for i in range(0, len(ask), 65536):
            part = ask[i : i + 65536]
            at = own[np.searchsorted(q[own], q[part])]  # every query has its vector among its rows
            sim[part] = np.einsum("ij,ij->i", unpacked(rows.column(4).take(pa.array(at))), unpacked(rows.column(4).take(pa.array(part))))
        mark[ask] = 2
        keep = np.concatenate([*keep, ask])
        node, nid, sim, mark = _top(q[keep], m[keep], sim[keep], mark[keep], beam)
        o = np.flatnonzero(mark == 2)
        if len(o):
            starts = np.flatnonzero(np.concatenate([[True], node[o][1:] != node[o][:-1]]))
            rank = np.arange(len(o)) - np.repeat(starts, np.diff(np.append(starts, len(o))))
            mark[o[rank < follow]] = 1
        return pa.RecordBatch.from_pydict(_edges(node, nid, sim, mark))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            rest.append(b)
            rows = pa.Table.from_batches(rest).combine_chunks().to_batches()[0]
            q = rows.column(0).to_numpy()
            if last := int(np.searchsorted(q, q[-1])):
                yield settle(rows.slice(0, last))
            rest = [rows.slice(last)]
        if rest:
            yield settle(rest[0])

    return run


def search_graph(points: DataFrame, n: int, graph: DataFrame, queries: DataFrame, beam: int = 128, follow: int = 32, rounds: int = 3) -> DataFrame:
    """Beams (node, nid, sim, mark) of the ``queries`` (q, vq), which may be nodes of the graph or not.

    ``vq`` is a vector as in ``packed`` with zero as its last component. A node of a beam has mark 2 until it is to be
    followed, 1 then, and 0 after that.
    """
    ids, drawn = _drawn(points, n, ENTRIES)
    back = _reverse(graph, F.desc("sim"))
    around = cut(graph.select("node", "nid").unionByName(back.select(F.col("nid").alias("node"), F.col("node").alias("nid"))).distinct())

    def enter(batches):
        for b in batches:
            q = b.column(0).to_numpy()
            if len(q) and len(ids):
                s = unpacked(b.column(1)) @ drawn.T
                a, c = np.nonzero(q[:, None] != ids[None])
                yield pa.RecordBatch.from_pydict(_edges(q[a], ids[c], s[a, c], np.full(len(a), 2)))

    state = queries.select("q", "vq").mapInArrow(enter, EDGES)
    frontier, before = queries.select("q", F.col("q").alias("node")), None
    asked = queries.select("q", F.lit(None).cast("long").alias("m"), F.lit(None).cast("float").alias("sim"), F.lit(-1).alias("mark"), F.col("vq").alias("v"))
    for _ in range(rounds + 1):
        reached = frontier.join(around, "node").select("q", F.col("nid").alias("m")).where("q <> m").distinct()
        held = state.select(F.col("node").alias("q"), F.col("nid").alias("m"), "sim", "mark")
        fetched = reached.join(held.select("q", "m"), ["q", "m"], "left_anti").join(points.select(F.col("id").alias("m"), "v"), "m")
        rows = held.withColumn("v", F.lit(None).cast("binary")).unionByName(fetched.select("q", "m", F.lit(None).cast("float").alias("sim"), F.lit(-2).alias("mark"), "v")).unionByName(asked)
        state = cut(rows.repartition("q").sortWithinPartitions("q").mapInArrow(_merged(beam, follow), EDGES), replaces=before)
        before, frontier = state, state.where("mark = 1").select(F.col("node").alias("q"), F.col("nid").alias("node"))
    return state


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", beam: int = 128) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest other rows found for each row of which ``is_query`` holds."""
    rows = cut(usable(vectors, vec_id, embedding))
    n = rows.count()
    points = cut(_points(rows))
    ids = rows.withColumnRenamed("id", vec_id).where(is_query).select(F.col(vec_id).alias("id"))
    queries = cut(points.join(ids, "id", "left_semi").select(F.col("id").alias("q"), F.col("q").alias("vq")))
    beams = search_graph(points, n, build_graph(points, n), queries, beam=max(beam, 2 * k))
    few = _best(beams, 2 * k).select(F.col("node").alias("query_id"), F.col("nid").alias("id"))
    pairs = few.join(rows, "id").join(rows.select(F.col("id").alias("query_id"), F.col("x").alias("y")), "query_id")
    exact = pairs.select("query_id", F.col("id").alias("vec_id"), F.aggregate(F.zip_with("x", "y", lambda a, b: a * b), F.lit(0.0), lambda s, p: s + p).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return exact.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
