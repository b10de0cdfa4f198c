"""Near-duplicate documents by a parity-sketch join on word shingles (operator 9).

Two sets of sizes a and b have a Jaccard likeness of at least 0.8 just if their symmetric difference is at most
(a + b) / 9. Hashed to the cells of a sketch and combined there by exclusive or, elements of both sets cancel, so each
differing element changes at most one cell, and sketches differ in no more places than the sets do.

1. Sets of one size band (by powers of four; one near the next band takes part there too) are hashed to the same
   number of cells, a 64-bit exclusive or in each. With at most t differing cells, the t + 1 cells that come first in
   any order common to all documents share one between two alike sets (pigeonhole). The order puts cells with rare
   shingles first, by counts over all documents, kept by hash in a table of bounded size.
2. Equal cells are brought together by a shuffle and a sort. A small group gives its pairs; a large one gives pairs with
   its first member.
3. Candidates pass if their bit sketches (one parity bit for each of four cells an element) differ in at most t bits;
   the rest is compared by exact sets of 64-bit shingle hashes, built again from the texts of the documents concerned.
4. Links join into components. Large groups that are still of different components are compared for pairs of
   different ones, nearest pairs first. Members of groups above ``BLOCK`` sets are dealt to (half as many, larger) cells
   once more for that, now ordered by exact counts over all of them: cells that sets of one component alone have come
   first and bring nobody together. Groups that are above ``BLOCK`` even then are compared by pairs of blocks; only sets
   near a crowd of others of different components in all but a few cells get there.

Equal sets are one node, named by a 64-bit hash of the set; of a node seen before, a task sends no cells again.

Defined results: null, empty and blank texts have 0 shingles and are linked with nothing; rows that share an id are
documents of their own, and a component's id is the least of all its rows; rows with a null id take part and can't
give a component its id (null if all its rows have none); extra columns are left out; an empty table gives none.
A component's first row is that of the least id, nulls last, then of the least mark (a 64-bit hash of id and text).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrastock.llm.common import Shingler, cut, mix64, release, shuffles_removed, slices
from terrastock.llm.components import connected_components

#: Groups of up to so many nodes give all their pairs at once.
SMALL = 8
BLOCK = 256
_TABLE_BITS, _BITMAP_BITS = 22, 22
#: Places of the table of counts that make one row.
_ROW = 4096
SIGNATURES = "doc_id long, mark long, n long, node long, cells array<long>, sketch binary"


def mark(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A 64-bit name for a row's id and text together; never null."""
    return F.xxhash64(F.col(doc_id).cast("long"), F.col(text))


def difference_limit(a, b):
    """The largest symmetric difference that two alike sets of these sizes can have."""
    return (a + b) // 9


def _longest_partner(n: int) -> int:
    return n * 5 // 4


def parity_bits(shingles: np.ndarray) -> bytes:
    """A parity bit for each of the (power of two) cells, four or more for an element."""
    m = max(64, 1 << (4 * len(shingles) - 1).bit_length())
    return np.packbits((np.bincount((shingles & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1).astype(np.uint8)).tobytes()


def bit_distance(a: bytes, b: bytes) -> int:
    """Differing bits of two parity sketches; the longer one is folded to the shorter one's length."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def node_of(shingles: np.ndarray) -> int:
    """A signed 64-bit name for a set that isn't empty."""
    both = np.array([len(shingles), np.add.reduce(shingles), np.bitwise_xor.reduce(shingles)], np.uint64)
    x = mix64(both[:1])
    for v in both[1:]:
        x = mix64(x * np.uint64(0x9E3779B97F4A7C15) + v)
    return int(x.view(np.int64)[0])


def _named_cells(shingles: np.ndarray, band: int, limit: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of those of 2**bits cells of a set in one band that hold something, and of the empty ones if those may be too few."""
    first = np.uint64((band + 1) << 40)
    part = shingles >> np.uint64(64 - bits)
    starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    names = mix64(np.bitwise_xor.reduceat(shingles, starts) ^ mix64(part[starts] + first)) >> np.uint64(2)
    if len(names) > limit:
        return names, names[:0]
    free = np.setdiff1d(np.arange(1 << bits, dtype=np.uint64), part[starts]) + first
    return names, mix64(mix64(free)) >> np.uint64(2)


def _places(shingles: np.ndarray, size: int) -> np.ndarray:
    """Their places in a table of a power of two."""
    return (shingles >> np.uint64(8)).astype(np.int64) & (size - 1)


def _commonness(shingles: np.ndarray, bits: int, common: np.ndarray) -> np.ndarray:
    """For each cell that holds something, below 1023: the level of its rarest shingle, then of the next (31 if it has one alone)."""
    part = shingles >> np.uint64(64 - bits)
    same = part[1:] == part[:-1]
    starts = np.flatnonzero(np.concatenate([[True], ~same]))
    level = np.sort((part << np.uint64(5)) | common[_places(shingles, len(common))].astype(np.uint64)) & np.uint64(31)
    following = np.where(np.append(same, False), np.append(level[1:], level[:1]), np.uint64(31))
    return (level[starts] << np.uint64(5)) | following[starts]


def _bands(n: int) -> list[tuple[int, int]]:
    """Bands in which a set of ``n`` takes part, and the largest difference from a set like it but not equal there."""
    band = (n.bit_length() - 1) // 2
    above = 4 ** (band + 1)
    found = []
    if limit := difference_limit(n, min(_longest_partner(n), above - 1)):
        found.append((band, limit))
    if _longest_partner(n) >= above:
        found.append((band + 1, difference_limit(n, _longest_partner(n))))
    return found


def cells_of(shingles: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Cells by which a set must meet every set like it but not equal: in each band as many as may differ and one more,
    those with rare shingles first, empty ones last. ``common``: levels (up to 30) by place, low ones for rare shingles."""
    found = [np.zeros(0, np.uint64)]
    for band, limit in _bands(len(shingles)):
        bits = 2 * band + 1
        names, empty = (x >> np.uint64(8) for x in _named_cells(shingles, band, limit, bits))
        ranked = np.concatenate([(_commonness(shingles, bits, common) << np.uint64(54)) | names, (np.uint64(1023) << np.uint64(54)) | empty])
        found.append(np.partition(ranked, limit)[: limit + 1])
    return np.concatenate(found).view(np.int64)


def common_shingles(docs: DataFrame) -> np.ndarray:
    """A table by hash of how often shingles occur in all texts of ``docs``, as binary logarithms rounded down.

    Each task counts into a table of its own, whose rows are then added up by Spark.
    """
    size = 1 << _TABLE_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, counts = Shingler(), np.zeros(size, np.uint32)
        for b in batches:
            texts = b.column(0).to_pylist()
            for i, j in slices(texts):
                for s in shingler.sequences(texts[i:j]):
                    np.add.at(counts, _places(s, size), np.uint32(1))
        for shift in (0, 8, 16, 24):  # by bytes, as most counts are small
            part = (counts >> np.uint32(shift)).astype(np.uint8).reshape(-1, _ROW)
            rows = np.flatnonzero(part.any(axis=1))
            made = [pa.array(rows, pa.int64()), pa.array(np.full(len(rows), shift), pa.int64()), pa.array([x.tobytes() for x in part[rows]], pa.binary())]
            yield pa.RecordBatch.from_arrays(made, names=["row", "shift", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for row, shift, counts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                sums.setdefault(row, np.zeros(_ROW, np.int64))
                sums[row] += np.frombuffer(counts, np.uint8).astype(np.int64) << shift
        levels = [np.minimum(np.frexp(np.maximum(x, 1))[1] - 1, 30).astype(np.uint8).tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(levels, pa.binary())], names=["row", "levels"])

    counted = docs.select("text").mapInArrow(count, "row long, shift long, counts binary").repartition("row").mapInArrow(add, "row long, levels binary")
    table = np.zeros((size // _ROW, _ROW), np.uint8)
    for r in cut(counted).toLocalIterator():
        table[r["row"]] = np.frombuffer(r["levels"], np.uint8)
    return table.ravel()


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, n, node, cells, sketch) of (doc_id, text). Node is null without shingles; cells and sketch are null
    too for a node that the task has met before."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(common_shingles(docs).tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = np.frombuffer(shared.value, np.uint8)
        shingler, met = Shingler(), set()
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in slices(texts):
                n, nodes, cells, sketches = [], [], [], []
                for s in shingler.sets(texts[i:j]):
                    node = node_of(s) if len(s) else None
                    fresh = node is not None and node not in met
                    if len(met) >= 500_000:
                        met.clear()
                    met.add(node)
                    n.append(len(s))
                    nodes.append(node)
                    cells.append(cells_of(s, common) if fresh else None)
                    sketches.append(parity_bits(s) if fresh else None)
                made = [pa.array(n, pa.int64()), pa.array(nodes, pa.int64()), pa.array(cells, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), *made], names=["doc_id", "mark", "n", "node", "cells", "sketch"])

    return docs.select("doc_id", "text", mark().alias("mark")).mapInArrow(run, SIGNATURES)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of nodes that share a cell, from rows sorted by cell and node. Those of large groups keep their cell."""
    cell, node, big = np.zeros(0, np.int64), np.zeros(0, np.int64), False

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["cell", "a", "b"])

    def group(name: int, members: np.ndarray, star: bool) -> list[tuple]:
        if star or len(members) > SMALL:
            return [(name, int(members[0]), int(m)) for m in members[1:]]
        return [(None, int(x), int(y)) for k, x in enumerate(members) for y in members[k + 1 :]]

    def settle(cell: np.ndarray, node: np.ndarray, first_big: bool) -> list[tuple]:
        starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        sizes = np.diff(np.append(starts, len(cell)))
        return [r for s, z in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True) for r in group(int(cell[s]), node[s : s + z], first_big and s == 0)]

    for b in batches:
        cell = np.concatenate([cell, b.column(0).to_numpy()])
        node = np.concatenate([node, b.column(1).to_numpy()])
        if not len(cell):
            continue
        new = np.concatenate([[True], (cell[1:] != cell[:-1]) | (node[1:] != node[:-1])])
        cell, node = cell[new], node[new]
        last = int(np.searchsorted(cell != cell[-1], False)) if cell[0] == cell[-1] else len(cell) - int(np.argmax(cell[::-1] != cell[-1]))
        if last:
            if rows := settle(cell[:last], node[:last], big):
                yield emit(rows)
            cell, node, big = cell[last:], node[last:], False
        if len(cell) > 20_000:
            yield emit(group(int(cell[0]), node, True))
            cell, node, big = cell[:1], node[:1], True
    if len(cell) and (rows := settle(cell, node, big)):
        yield emit(rows)


def _near(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of candidate pairs (a, b), those whose sizes and bit sketches allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            na, nb, sa, sb = (b.column(i).to_pylist() for i in range(2, 6))
            keep = [k for k in range(len(na)) if bit_distance(sa[k], sb[k]) <= difference_limit(na[k], nb[k])]
            yield b.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    sized = pairs.join(side("a"), "a").join(side("b"), "b").where("least(na, nb) * 5 >= greatest(na, nb) * 4")
    return sized.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long")


def _sets(wanted: DataFrame, owners: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, shingles binary) of the nodes in ``wanted``. ``owners``: the mark of a row for each node."""
    wanted = wanted.select("node").distinct().join(owners.select("node", "mark"), "node")
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << _BITMAP_BITS))
    # a bitmap of bounded size keeps texts that nobody needs from being shuffled
    maps = wanted.groupBy(F.bitmap_bucket_number(place("mark") + 1).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place("mark") + 1)).alias("bits"))
    bits = np.zeros(1 << _BITMAP_BITS, bool)
    for r in maps.collect():
        own = np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little")
        bits[(r["k"] - 1) * len(own) : r["k"] * len(own)] = own
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(bits).tobytes())

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, met = np.unpackbits(np.frombuffer(shared.value, np.uint8)).astype(bool), set()
        for b in batches:
            marks, keep = b.column(0).to_pylist(), []
            for k in np.flatnonzero(table[b.column(2).to_numpy()]).tolist():
                if marks[k] not in met:  # rows that repeat id and text are sent once by a task
                    keep.append(k)
                    if len(met) >= 500_000:
                        met.clear()
                    met.add(marks[k])
            yield b.select(["mark", "text"]).take(pa.array(keep, pa.int64()))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for b in batches:
            nodes, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, j in slices(texts):
                made = shingler.sets(texts[i:j])
                right = [k for k, (node, s) in enumerate(zip(nodes[i:j], made, strict=True)) if len(s) and node_of(s) == node]
                yield pa.RecordBatch.from_arrays([pa.array([nodes[i + k] for k in right], pa.int64()), pa.array([made[k].tobytes() for k in right], pa.binary())], names=["node", "shingles"])

    texts = docs.select(mark().alias("mark"), "text").withColumn("place", place("mark")).mapInArrow(needed, "mark long, text string")
    return wanted.join(texts, "mark").select("node", "text").mapInArrow(sets, "node long, shingles binary").dropDuplicates(["node"])


def _verified(pairs: DataFrame, owners: DataFrame, docs: DataFrame) -> DataFrame:
    """Of pairs (a, b), those whose shingle sets, built again from the texts, are alike; other columns stay."""
    return _alike(pairs, cut(_sets(pairs.select(F.explode(F.array("a", "b")).alias("node")), owners, docs)))


def _alike(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """Of pairs (a, b), those whose shingle sets, as ``held``, are alike; other columns stay."""
    columns = pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b.column("sa").to_pylist(), b.column("sb").to_pylist()
            keep = []
            for k in range(len(x)):
                s, t = np.frombuffer(x[k], np.uint64), np.frombuffer(y[k], np.uint64)
                both = len(np.intersect1d(s, t, assume_unique=True))
                if 100 * both >= 80 * (len(s) + len(t) - both):
                    keep.append(k)
            yield b.select(columns).take(pa.array(keep, pa.int64()))

    side = lambda x: held.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select(*columns, "sa", "sb").mapInArrow(run, pairs.schema)


def _distances(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Differing bits of all pairs of parity sketches, by array operations for each pair of lengths."""
    out = np.zeros((len(left), len(right)), np.int64)
    by_size = lambda sketches: {z: np.array([k for k, x in enumerate(sketches) if len(x) == z]) for z in set(map(len, sketches))}

    def folded(sketches: list[bytes], at: np.ndarray, size: int) -> np.ndarray:
        x = np.frombuffer(b"".join(sketches[k] for k in at), np.uint8).reshape(len(at), -1)
        while x.shape[1] > size:
            x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
        return np.ascontiguousarray(x).view(np.uint64)

    for zl, il in by_size(left).items():
        for zr, ir in by_size(right).items():
            x, y = folded(left, il, min(zl, zr)), folded(right, ir, min(zl, zr))
            for k, row in zip(il.tolist(), x, strict=True):
                out[k, ir] = np.bitwise_count(row ^ y).sum(axis=1)
    return out


def _open_groups(met: DataFrame, labels: DataFrame) -> DataFrame:
    """(cell, n_cell, node, component) of those large groups that are not of one component; ``n_cell`` is their size."""
    large = met.where(F.col("cell").isNotNull())
    members = large.select("cell", F.col("b").alias("node")).unionByName(large.select("cell", F.col("a").alias("node")).distinct())
    known = members.join(labels, "node", "left").select("cell", "node", F.coalesce("component", "node").alias("component"))
    mixed = known.groupBy("cell").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n_cell")).where("low <> high")
    return known.join(mixed.select("cell", "n_cell"), "cell").select("cell", "n_cell", "node", "component")


def _all_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every cell, of half as many, of the sets of a batch; ``most`` is how many of the rarest ones of a band are needed."""
    for b in batches:
        kept, cell, band, most, free = [], [], [], [], []
        for k, x in enumerate(b.column(2).to_pylist()):
            for own, limit in _bands(len(x) // 8):
                names, empty = _named_cells(np.frombuffer(x, np.uint64), own, limit, 2 * own)
                n = len(names) + len(empty)
                kept.append(np.full(n, k))
                cell += [names, empty]
                band.append(np.full(n, own, np.int8))
                most.append(np.full(n, limit + 1, np.int32))
                free.append(np.arange(n) >= len(names))
        if kept:
            made = [np.concatenate(cell).view(np.int64), np.concatenate(band), np.concatenate(most), np.concatenate(free)]
            yield pa.RecordBatch.from_arrays([*b.select([0, 1]).take(pa.array(np.concatenate(kept))).columns, *map(pa.array, made)], names=["node", "component", "cell", "band", "most", "free"])


def _dealt_again(held: DataFrame) -> DataFrame:
    """(cell, n_cell, node) of the rarest cells of each set, by exact counts over all sets of ``held``.

    ``held``: (node, component, shingles). Cells that sets of one component alone have come first in the order, as no
    sets of different ones share them, and bring nobody together. So a set that has more of them than it may differ in
    is done. ``n_cell`` is the count.
    """
    cells = cut(held.mapInArrow(_all_cells, "node long, component long, cell long, band byte, most int, free boolean"))
    counts = cells.groupBy("cell").agg(F.count("*").alias("n_cell"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    counted = cells.join(counts.select("cell", "n_cell"), "cell", "left")
    # cells that come first need not be told apart
    ordered = counted.groupBy("node", "band", "most").agg(
        F.count_if(F.col("n_cell").isNull()).cast("int").alias("alone"),
        F.array_sort(F.collect_list(F.when(F.col("n_cell").isNotNull(), F.struct("free", "n_cell", "cell")))).alias("order"),
    )
    first = ordered.where("most > alone").select("node", F.explode(F.slice("order", F.lit(1), F.col("most") - F.col("alone"))).alias("c"))
    return cut(first.select("c.cell", "c.n_cell", "node"), replaces=cells)


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows that agree in the first ``keys`` columns, which the batches are sorted by."""
    rest: list[pa.RecordBatch] = []
    for b in batches:
        rest.append(b)
        whole = pa.Table.from_batches(rest).combine_chunks().to_batches()
        if not whole:
            continue
        rows = whole[0]
        key = np.stack([rows.column(i).to_numpy() for i in range(keys)])
        starts = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)])).tolist()
        for i, j in zip(starts, starts[1:], strict=False):
            yield rows.slice(i, j - i)
        rest = [rows.slice(starts[-1])]
    if rest and (whole := pa.Table.from_batches(rest).combine_chunks().to_batches()):
        yield whole[0]


def _between_components(dealt: DataFrame, known: DataFrame, most: int) -> DataFrame:
    """Pairs (a, b, ca, cb) of nodes of different components ca and cb that share a cell and may be alike.

    ``known``: (node, component, n, sketch). A group of more than ``BLOCK`` nodes is dealt to blocks by hash and its
    blocks compared in pairs. Each node gives its ``most`` nearest ones in each other block; a number above every
    block's size gives all. A row of nulls tells that some pair was left out for that.
    """
    blocks = F.ceil(F.col("n_cell") / BLOCK).cast("int")
    own = dealt.join(known, "node").withColumn("k", blocks).withColumn("own", F.pmod(F.xxhash64("node"), "k").cast("int"))
    spread = own.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    spread = spread.select("cell", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "own", "node", "component", "n", "sketch")

    def compare(rows: pa.RecordBatch) -> tuple[np.ndarray, bool]:
        """Rows (a, b, ca, cb), and whether that is all."""
        own, node, component, n = (rows.column(c).to_numpy() for c in ("own", "node", "component", "n"))
        sketch = rows.column("sketch").to_pylist()
        x, y = (np.flatnonzero(own == rows.column(c)[0].as_py()) for c in ("i", "j"))
        nx, ny = n[x][:, None], n[y][None]
        limit, distance = difference_limit(nx, ny), _distances([sketch[k] for k in x], [sketch[k] for k in y])
        ok = (component[x][:, None] != component[y][None]) & (5 * np.minimum(nx, ny) >= 4 * np.maximum(nx, ny)) & (distance <= limit)
        every = ok.sum()
        if most < len(y):
            far = np.where(ok, distance / (limit + 1.0), np.inf)
            ok &= far <= np.partition(far, most - 1, axis=1)[:, most - 1 : most]
            ok &= np.cumsum(ok, axis=1) <= most
        i, j = np.nonzero(ok)
        a, b = x[i], y[j]
        turn = node[a] > node[b]
        a, b = np.where(turn, b, a), np.where(turn, a, b)
        return np.stack([node[a], node[b], component[a], component[b]]), len(i) == every

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, whole, found, held = ["a", "b", "ca", "cb"], True, [], 0
        for rows in _groups(batches, 3):
            if rows.num_rows < 2 or (c := rows.column("component").to_numpy()).min() == c.max():
                continue
            pairs, all_of_them = compare(rows)
            whole &= all_of_them
            if pairs.shape[1]:
                found.append(pairs)
                held += pairs.shape[1]
            if held > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.unique(np.concatenate(found, axis=1), axis=1)], names=names)
                found, held = [], 0
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.unique(np.concatenate(found, axis=1), axis=1)], names=names)
        if not whole:
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64())] * 4, names=names)

    return spread.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j").mapInArrow(run, "a long, b long, ca long, cb long").distinct()


def _join_left_over(met: DataFrame, labels: DataFrame, nodes: DataFrame, owners: DataFrame, docs: DataFrame) -> DataFrame:
    """``labels`` with the links inside the large groups of ``met``."""
    groups = cut(_open_groups(met, labels))
    if groups.isEmpty():
        return labels
    sized = cut(nodes.join(groups.select("node").distinct(), "node", "left_semi"))
    dealt = groups.where(F.col("n_cell") <= BLOCK).select("cell", "n_cell", "node")
    crowd = cut(groups.where(F.col("n_cell") > BLOCK).select("node", "component").distinct())
    if not crowd.isEmpty():
        held = cut(_sets(crowd, owners, docs).join(crowd, "node").select("node", "component", "shingles"))
        dealt = dealt.unionByName(_dealt_again(held))
        release(held)
    refuted = None
    for most in (1, 1 << 30):  # the nearest ones join most components, after which few pairs are left
        known = sized.join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "n", "sketch")
        found = cut(_between_components(dealt, known, most))
        whole = found.where("a IS NULL").isEmpty()
        pairs = found.where("a IS NOT NULL")
        if refuted is not None:
            pairs = pairs.join(refuted, ["a", "b"], "left_anti")
        links = cut(_verified(pairs, owners, docs).select("ca", "cb"))
        if not links.isEmpty():
            stars = labels.select(F.col("node").alias("a"), F.col("component").alias("b"))
            labels = connected_components(stars.unionByName(links.select(F.col("ca").alias("a"), F.col("cb").alias("b"))))
        if whole:  # each pair that was of different components has been compared
            break
        refuted = pairs.select("a", "b")  # those found alike are of one component now
    return labels


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, node, mark, first) of every row of ``docs``; ``first`` is the mark of its component's first row."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    with shuffles_removed(docs.sparkSession):
        return _near_duplicates(docs)


def _near_duplicates(docs: DataFrame) -> DataFrame:
    with_cells = cut(signatures(docs))
    cells = with_cells.select(F.explode("cells").alias("cell"), "node")
    met = cut(cells.repartition("cell").sortWithinPartitions("cell", "node").mapInArrow(_meet, "cell long, a long, b long").distinct())
    signed = cut(with_cells.drop("cells"), replaces=with_cells)
    nodes = signed.where(F.col("sketch").isNotNull()).select("node", "n", "sketch").dropDuplicates(["node"])
    earliest = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "mark")).alias("row")
    owners = cut(signed.where(F.col("node").isNotNull()).groupBy("node").agg(earliest).select("node", "row.doc_id", "row.mark"))
    near = cut(_near(met.select("a", "b").distinct(), nodes))
    links = cut(_verified(near, owners, docs))
    labels = _join_left_over(met, connected_components(links), nodes, owners, docs)
    named = owners.join(labels, "node", "left").select("node", "doc_id", "mark", F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(earliest).select("component", F.col("row.doc_id").alias("component_id"), F.col("row.mark").alias("first"))
    by_node = named.join(least, "component").select("node", "component_id", "first")
    out = signed.select("doc_id", "mark", "n", "node").join(by_node, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "node", "mark", "first")
