"""Removal of passages that an earlier document holds (operator 13), by difference-cover anchors.

A window is ``window`` consecutive words of one document. A word goes if it lies in a window whose words also stand in a
document with a smaller id. Words are runs of anything but ASCII white space, unchanged.

Anchors. ``COVER`` is a set of places modulo ``PERIOD`` such that any two offsets are both brought onto it by one shift
below the period. An anchor is the run of ``window - PERIOD + 1`` words that begins at a place of the cover, so two equal
windows, wherever they begin, share an anchor at the same place inside. Only anchors are hashed and dealt out, about one
for five words.

1. Each task hashes the anchors of its texts, and for each the words as far as any window with that anchor reaches (its
   context). Of anchors with equal contexts in a chunk of texts only those of the smallest id go on, the others' windows
   are repeats; of equal anchors with different contexts all but one go on under their contexts, since the chunk shows
   that they are shared. So no anchor has more rows than there are chunks, however common it is.
2. Dealt by anchor, those that just one document has are dropped; those whose context a smaller id has are repeats with
   all their windows; the others stay in doubt.
3. Extension: texts meet their doubtful anchors, and each window that holds one and is not yet a repeat is hashed to 128
   bits. Windows go the way of anchors: a chunk passes on those of its smallest id, and dealt by hash they tell which of
   them a smaller id has.
4. Texts meet their ranges of repeated windows and lose the words that these cover.

No pairs of documents are made, and nothing is collected.

Defined results: a null text has no words and stays null; a text without repeats is unchanged, from others the kept words
are joined by one space; rows with a null id are kept whole and make nothing a repeat; rows that share an id are no
repeats of each other; extra columns pass through, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrastock.llm.common import _WordHashes, cut, mix64, shuffles_removed, slices

WINDOW, PERIOD = 50, 31
#: Anchors, or windows, that a task compares by itself at a time; only cost depends on it.
CHUNK = 600_000
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
#: Rows that are dealt out are narrow: a span holds the first window, how many follow it, and the state, which is 0 for
#: rows to be judged, 1 for those known to be shared, 2 for those known to be repeated.
DEALT = "k long, x long, id long, of_text long, span long"


def difference_cover(period: int) -> np.ndarray:
    """The first smallest set of places below ``period`` whose differences give every shift."""
    size = 1
    while True:
        while size * (size - 1) + 1 < period:
            size += 1
        for rest in combinations(range(1, period), size - 1):
            places = (0, *rest)
            if len({(a - b) % period for a in places for b in places}) == period:
                return np.array(places)
        size += 1


class Hashed:
    """Hashes of runs of words of several texts, read off running sums."""

    def __init__(self, texts: list[str | None], hashes: _WordHashes) -> None:
        if len(hashes) >= _WordHashes.MOST:
            hashes.clear()
        self.words = [(t or "").encode().split() for t in texts]
        self.n = np.fromiter(map(len, self.words), np.int64, len(texts))
        self.base = np.cumsum(self.n) - self.n
        total, get = int(self.n.sum()), hashes.__getitem__
        flat = np.fromiter((h for ws in self.words for h in map(get, ws)), np.uint64, total)
        self.sums, self.back = [], []
        for m, h in zip(MULTIPLIERS, (flat, mix64(flat ^ np.uint64(MULTIPLIERS[1]))), strict=True):
            power = np.cumprod(np.full(total + 1, m, np.uint64))
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power[:total])]))
            self.back.append(np.cumprod(np.full(total + 1, pow(m, -1, 2**64), np.uint64)))

    def of(self, which: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """One of two hashes of the words from ``start`` to ``end``, places over all texts."""
        s = self.sums[which]
        return mix64((s[end] - s[start]) * self.back[which][start])


def _runs(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges [lo, hi] of places in documents, sorted by both, with those that touch made one."""
    if not len(doc):
        return doc, lo, hi
    top = np.maximum.accumulate(hi + (doc << 40)) - (doc << 40)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (lo[1:] > top[:-1] + 1)
    first = np.flatnonzero(new)
    return doc[first], lo[first], top[np.append(first[1:], len(doc)) - 1]


def _batch(k, x, ids, of_text, lo, hi, state) -> pa.RecordBatch:
    span = (lo.astype(np.int64) << 32) | ((hi - lo).astype(np.int64) << 2) | np.asarray(state).astype(np.int64)
    longs = [pa.array(np.ascontiguousarray(c).view(np.int64)) for c in (k, x, ids, of_text, span)]
    return pa.RecordBatch.from_arrays(longs, names=[c.split()[0] for c in DEALT.split(", ")])


def _first_of_chunk(k, x, ids, of_text, lo, hi, single: bool) -> Iterator[pa.RecordBatch]:
    """What a chunk passes on of rows (key, context, id, text, window starts), see the module's text. ``single``: rows of
    a key are alike, so that no contexts are told apart."""
    if not len(k):
        return
    o = np.lexsort((ids, x, k))
    k, x, ids, of_text, lo, hi = (c[o] for c in (k, x, ids, of_text, lo, hi))
    new_k = np.concatenate([[True], k[1:] != k[:-1]])
    new_x = new_k | np.concatenate([[True], x[1:] != x[:-1]])
    per_x, per_k = np.cumsum(new_x) - 1, np.cumsum(new_k) - 1
    at_k = np.flatnonzero(new_k)
    repeated = ids > ids[np.flatnonzero(new_x)][per_x]
    low, high = np.minimum.reduceat(ids, at_k)[per_k], np.maximum.reduceat(ids, at_k)[per_k]
    shared = low < high
    least = np.flatnonzero(ids == low)
    first = np.zeros(len(k), bool)
    first[least[np.unique(per_k[least], return_index=True)[1]]] = True
    if not single:  # but the first, anchors known to be shared are dealt by their contexts
        k = np.where(shared & ~first, mix64(k ^ mix64(x)), k)
    on = ~repeated
    state = np.zeros(len(k), np.int32) if single else shared
    yield _batch(k[on], x[on], ids[on], of_text[on], lo[on], hi[on], state[on])
    if repeated.any():
        ids, of_text, lo, hi = (c[repeated] for c in (ids, of_text, lo, hi))
        o = np.lexsort((hi, lo, of_text, ids))
        ids, of_text, lo, hi = (c[o] for c in (ids, of_text, lo, hi))
        doc = np.cumsum(np.concatenate([[0], (ids[1:] != ids[:-1]) | (of_text[1:] != of_text[:-1])])).astype(np.int64)
        place = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        d, a, b = _runs(doc, lo, hi)
        alone = mix64(mix64(ids[place[d]].view(np.uint64) ^ of_text[place[d]].view(np.uint64)) + a.astype(np.uint64))
        yield _batch(alone, alone, ids[place[d]], of_text[place[d]], a, b, np.full(len(d), 2))


class _Chunks:
    """Gathers rows until there are enough to compare."""

    def __init__(self, single: bool) -> None:
        self.single, self.rows, self.held = single, [], 0

    def add(self, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.rows.append(columns)
        self.held += len(columns[0])
        if self.held >= CHUNK:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield from _first_of_chunk(*(np.concatenate(c) for c in zip(*self.rows, strict=True)), self.single)
        self.rows, self.held = [], 0


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of several groups of so many."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _anchors(window: int, period: int):
    length, cover = window - period + 1, difference_cover(period)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, chunks = _WordHashes(), _Chunks(single=False)
        for b in batches:
            ids, of_text = (b.column(i).to_numpy() for i in (0, 1))
            texts = b.column(2).to_pylist()
            for i, j in slices(texts):
                h = Hashed(texts[i:j], hashes)
                longest = int(h.n.max(initial=0))
                places = (np.arange(0, longest + period, period)[:, None] + cover).ravel()
                counts = np.where(h.n >= window, np.searchsorted(places, h.n - length, side="right"), 0)
                doc, p = np.repeat(np.arange(j - i), counts), places[_within(counts)]
                n, base = h.n[doc], h.base[doc]
                left, right = np.maximum(0, p - period + 1), np.minimum(n, p + window)
                k = h.of(0, base + p, base + p + length)
                x = mix64(h.of(1, base + left, base + right) + ((p - left) * (window + 1) + right - p).astype(np.uint64))
                yield from chunks.add(k, x, ids[i:j][doc], of_text[i:j][doc], left, np.minimum(p, n - window))
        yield from chunks.flush()

    return run


def _ranges_of(column: pa.Array, i: int, j: int, base: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, from, to) over all texts of rows ``i`` to ``j`` of a column of lists of ranges."""
    part = column.slice(i, j - i)
    counts = np.diff(part.offsets.to_numpy()) * part.is_valid().to_numpy(zero_copy_only=False)
    flat, doc = part.flatten(), np.repeat(np.arange(j - i), counts)
    lo, hi = (flat.field(c).to_numpy().astype(np.int64) for c in (0, 1))
    return doc, base[doc] + lo, base[doc] + hi


def _marked(total: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Which of ``total`` places lie in a range [lo, hi]."""
    step = np.bincount(lo, minlength=total + 1) - np.bincount(hi + 1, minlength=total + 1)
    return np.cumsum(step[:total]) > 0


def _windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, chunks = _WordHashes(), _Chunks(single=True)
        for b in batches:
            ids, of_text = (b.column(i).to_numpy() for i in (0, 1))
            texts = b.column(2).to_pylist()
            for i, j in slices(texts):
                h = Hashed(texts[i:j], hashes)
                total = int(h.n.sum())
                known, doubtful = (_marked(total, *_ranges_of(b.column(c), i, j, h.base)[1:]) for c in (3, 4))
                at = np.flatnonzero(doubtful & ~known)
                doc = np.searchsorted(h.base, at, side="right") - 1
                start = at - h.base[doc]
                yield from chunks.add(h.of(0, at, at + window), h.of(1, at, at + window), ids[i:j][doc], of_text[i:j][doc], start, start)
        yield from chunks.flush()

    return run


def _kept(window: int, tidy: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in slices(texts):
                words = [(t or "").encode().split() for t in texts[i:j]]
                n = np.fromiter(map(len, words), np.int64, j - i)
                base = np.cumsum(n) - n
                _, lo, hi = _ranges_of(b.column(2), i, j, base)
                gone = _marked(int(n.sum()), lo, hi + window - 1)
                counts = np.add.reduceat(np.append(gone, False).astype(np.int64), np.minimum(base, len(gone))) * (n > 0)
                kept = [b" ".join(w).decode() for w in words] if tidy else texts[i:j]
                for d in np.flatnonzero(counts).tolist():
                    stay = ~gone[base[d] : base[d] + n[d]]
                    kept[d] = b" ".join(w for w, s in zip(words[d], stay.tolist(), strict=True) if s).decode()
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(kept, pa.string()), pa.array(n), pa.array(counts)], names=["rest", "text", "n", "gone"])

    return run


def _judged(rows: DataFrame, repeats_only: bool) -> DataFrame:
    """(id, of_text, from_, to_, repeated) of dealt rows: those of a key that one document has are left out."""
    key, alike = Window.partitionBy("k"), Window.partitionBy("k", "x")
    state, first = F.col("span").bitwiseAND(F.lit(3)), F.shiftright("span", 32)
    if not repeats_only:
        rows = rows.withColumns({"low": F.min("id").over(key), "high": F.max("id").over(key)}).where((state > 0) | (F.col("low") < F.col("high")))
    repeated = (state == 2) | (F.col("id") > F.min("id").over(alike))
    last = first + F.shiftright(F.col("span").bitwiseAND(F.lit(2**32 - 1)), 2)
    return rows.select("id", "of_text", first.cast("int").alias("from_"), last.cast("int").alias("to_"), repeated.alias("repeated"))


def drop_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, period: int | None = None, n_words: str = "n_words", n_removed: str = "n_removed", tidy: bool = False
) -> DataFrame:
    """``docs`` with ``text`` less its repeated passages, and the columns ``n_words`` (before) and ``n_removed``.

    ``period`` is at most ``window``, if not given about six tenths of it. With ``tidy`` every text is its kept words,
    joined by one space, null as an empty text.
    """
    period = period or max(1, window * PERIOD // WINDOW)
    if not 0 < period <= window:
        raise ValueError("the period must be at least 1 and at most the window")
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))  # names of the input can't clash
    whole, key = F.col("row").getField(text), F.col("row").getField(doc_id).cast("long")
    ids = row.select(key.alias("id")).where("id is not null").groupBy("id").count()
    unique = ids.where("count > 1").isEmpty()  # then ids alone tell rows apart
    of_text = F.lit(0).cast("long") if unique else F.xxhash64(F.coalesce(whole, F.lit("")))
    rest = [c for c in docs.columns if c not in (text, n_words, n_removed)]
    beside = F.struct(F.lit(0).alias("__none"), *(F.col("row").getField(c).alias(c) for c in rest)).alias("rest")
    told = row.select(key.alias("id"), of_text.alias("of_text"), whole.alias("body"), beside)
    dealt = told.where("id is not null")  # met twice in one form, so that Spark shuffles the texts once
    span = F.struct("from_", "to_")

    def gathered(marks: DataFrame, **kinds) -> DataFrame:
        return marks.groupBy("id", "of_text").agg(*(F.collect_set(F.when(v, span)).alias(k) for k, v in kinds.items()))

    with shuffles_removed(docs.sparkSession):
        marks = cut(_judged(dealt.select("id", "of_text", "body").mapInArrow(_anchors(window, period), DEALT), repeats_only=False))
    doubtful = gathered(marks, known=F.col("repeated"), doubtful=~F.col("repeated")).where(F.size("doubtful") > 0)
    windows = dealt.join(doubtful, ["id", "of_text"]).select("id", "of_text", "body", "known", "doubtful", "rest").mapInArrow(_windows(window), DEALT)
    found = marks.where("repeated").unionByName(_judged(windows, repeats_only=True).where("repeated")).select("id", "of_text", "from_", "to_")
    met = dealt.join(gathered(found, known=F.lit(True)), ["id", "of_text"], "left").select("rest", "body", "known")
    met = met.unionByName(told.where("id is null").select("rest", "body", F.lit(None).cast("array<struct<from_:int,to_:int>>").alias("known")))
    fields = [("rest", met.schema["rest"].dataType), ("text", T.StringType()), ("n", T.LongType()), ("gone", T.LongType())]
    out = T.StructType([T.StructField(*f) for f in fields])
    kept = met.mapInArrow(_kept(window, tidy), out)
    return kept.select(*(F.col("rest").getField(c).alias(c) for c in rest), F.col("text").alias(text), F.col("n").alias(n_words), F.col("gone").alias(n_removed))
