"""Document fingerprints as threshold-scaled sketches (operator 2).

A sketch retains every hash of a word shingle below a fixed fraction of the hash range, and always the ``FLOOR``
smallest, so that short texts keep something. Sketches merge by union, and two of them compare over the hashes that
both are sure to hold, however unequal the texts.

Neighbours in order of id are found without ordering the table in one place: it is split into ranges of (id, hash of the
text), the first row of each range (a list as long as there are partitions) is also sent to the range before, and each
range is streamed in order. Texts are shuffled once. A range that would hold one id only is split by the hashes.

Defined results: a null text counts as empty; an empty sketch is the empty string, as like to an empty one as can be
(1) and not at all to others (0); rows with equal ids follow by a hash of their text; null ids come first; extra columns are left
out by ``edited_by_next``; an empty table gives an empty table; a single row is its own neighbour.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrastock.llm.common import Shingler, shuffle_partitions, slices

FRACTION = 1 / 16
FLOOR = 32
LIMIT = np.uint64(int(2**64 * FRACTION))
EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, contained_in_edited double"


class Sketch:
    """The retained hashes, ascending, and up to where they are complete.

    Its text holds both, so that stored fingerprints can be read, merged and compared.
    """

    __slots__ = ("hashes", "reach")

    def __init__(self, hashes: np.ndarray, reach: int) -> None:
        self.hashes, self.reach = hashes, reach

    @classmethod
    def of(cls, shingles: np.ndarray) -> Sketch:
        """The sketch of a text's sorted distinct shingle hashes."""
        keep = max(int(np.searchsorted(shingles, LIMIT)), min(FLOOR, len(shingles)))
        return cls(shingles[:keep], 2**64 - 1 if keep == len(shingles) else max(int(LIMIT) - 1, int(shingles[keep - 1])))

    def text(self) -> str:
        return f"{self.reach:016x}{self.hashes.astype('>u8').tobytes().hex()}"

    @classmethod
    def parse(cls, text: str) -> Sketch:
        data = bytes.fromhex(text)
        return cls(np.frombuffer(data[8:], ">u8").astype(np.uint64), int.from_bytes(data[:8]))

    def merge(self, other: Sketch) -> Sketch:
        """The sketch of both sets together."""
        both = np.union1d(self.hashes, other.hashes)
        whole = min(self.reach, other.reach)
        known = int(np.searchsorted(both, np.uint64(whole), side="right"))
        keep = max(int(np.searchsorted(both, LIMIT)), min(FLOOR, known))
        if whole == 2**64 - 1 and keep == len(both):
            return Sketch(both, whole)
        return Sketch(both[:keep], max(int(LIMIT) - 1, int(both[keep - 1])))

    def compare(self, other: Sketch) -> tuple[float, float]:
        """Estimated Jaccard likeness, and how much of this one the other contains."""
        reach = np.uint64(min(self.reach, other.reach))
        a = self.hashes[: np.searchsorted(self.hashes, reach, side="right")]
        b = other.hashes[: np.searchsorted(other.hashes, reach, side="right")]
        if not len(a) or not len(b):
            same = float(len(self.hashes) == len(other.hashes) == 0)
            return same, same
        both = len(np.intersect1d(a, b, assume_unique=True))
        return both / (len(a) + len(b) - both), both / len(a)


def _firsts(places: DataFrame) -> list[tuple[int, int]]:
    """The first place (id, h) of each range that places are dealt to, in order, as many ranges as partitions at most.
    Equal ids are parted by their hashes, so that many rows of one id are many ranges."""
    n = shuffle_partitions(places.sparkSession)
    found = places.repartitionByRange(n, "id", "h").groupBy(F.spark_partition_id().alias("range")).agg(F.min(F.struct("id", "h")).alias("first")).collect()
    return sorted({(r["first"]["id"], r["first"]["h"]) for r in found})


def _range_of(firsts: list[tuple[int, int]], shift: int = 0) -> Column:
    """The number of the range that a place lies in, by halving the list of first places."""
    if len(firsts) <= 1:
        return F.lit(shift)
    half = len(firsts) // 2
    i, h = (F.lit(v).cast("long") for v in firsts[half])
    before = (F.col("id") < i) | ((F.col("id") == i) & (F.col("h") < h))
    return F.when(before, _range_of(firsts[:half], shift)).otherwise(_range_of(firsts[half:], shift + half))


def edited_by_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last quarter is replaced by the next document's start."""
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    base = base.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("id"), F.xxhash64("text").alias("h"), "doc_id", "text")
    firsts = _firsts(base.select("id", "h"))
    base = base.withColumn("range", _range_of(firsts))
    # rows at a range's first place go to it and, as guests, to the range before; those at the very first to the end of the last
    longs = lambda k: F.array(*(F.lit(f[k]).cast("long") for f in firsts or [(0, 0)]))
    is_first = (F.get(longs(0), F.col("range")) == F.col("id")) & (F.get(longs(1), F.col("range")) == F.col("h"))
    own = F.struct(F.col("range"), F.lit(0).alias("guest"))
    guest = F.struct(F.pmod(F.col("range") - 1, F.lit(max(1, len(firsts)))).alias("range"), F.lit(1).alias("guest"))
    sent = base.withColumn("to", F.explode(F.when(is_first, F.array(own, guest)).otherwise(F.array(own))))
    ordered = (
        sent.select(F.col("to.range").cast("long").alias("range"), F.col("to.guest").cast("long").alias("guest"), "doc_id", "text", "id", "h")
        .repartitionByRange(shuffle_partitions(docs.sparkSession), "range")
        .sortWithinPartitions("range", "guest", "id", "h", "text")
        .select("range", "guest", "doc_id", "text")
    )
    names = [x.split()[0] for x in EDITED.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64()]

    def rows(shingler: Shingler, group: list[tuple[int | None, str]]) -> pa.RecordBatch:
        """All but the last of ``group``, each with the one after it."""
        texts = [t for _, t in group]
        edited = [a[: len(a) - len(a) // 4] + b[: len(a) // 4] for a, b in zip(texts, texts[1:], strict=False)]
        own, changed = ([Sketch.of(s) for s in shingler.sets(x)] for x in (texts, edited))
        written = [s.text() for s in own[:-1]]
        near = [a.compare(b) for a, b in zip(own, changed, strict=False)]
        columns = [
            [k for k, _ in group[:-1]], list(map(len, texts[:-1])), [hashlib.sha256(t.encode()).hexdigest() for t in edited], written,
            [s.text() for s in changed], [x[0] for x in near], [a.compare(b)[0] for a, b in zip(own, own[1:], strict=False)], [x[1] for x in near],
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, held, closed, now = Shingler(), [], False, None
        for b in batches:
            ranges, guests, ids, texts = (b.column(i).to_pylist() for i in range(4))
            for i, j in slices(texts, 2_000_000):
                for k in range(i, j):
                    if ranges[k] != now:
                        if len(held) > 1:
                            yield rows(shingler, held)
                        held, closed, now = [], False, ranges[k]
                    if not closed:
                        held.append((ids[k], texts[k]))
                        closed = guests[k] == 1  # of rows at one place, which are alike, the first is the neighbour
                if len(held) > 1:
                    yield rows(shingler, held)
                    held = held[-1:]

    return ordered.mapInArrow(run, EDITED)
