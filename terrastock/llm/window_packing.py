"""Packing of token streams into windows, in document order (operator 5).

Each document becomes its ids and one separator. Documents follow each other as they come in their partition, and
dynamic programming chooses where the stream is cut into windows of at most ``window`` ids: at the end of a document
for nothing, after a sentence for ``sentence_penalty``, elsewhere (at every ``grid``-th id of a sentence) for
``word_penalty``; a window costs its padding. With ``f`` the least cost up to a cut,

    f(j) = cut(j) + window - j + min over i in [j - window, j) of (f(i) + i)

is a sliding-window minimum, kept in a monotone queue; windows whose length is a power of two need no padding and are
further transitions. One block of whole documents is solved at a time, so memory is bounded by a block or the longest
document. Tasks work alone: no shuffle, and a repeated task gives the same result, as sequence ids come from the
partition's number.

Defined results: a null text counts as empty, so its document is the separator alone; repeated rows are documents of
their own; an empty table gives no pieces; other columns are left out.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from terrastock.llm.common import slices
from terrastock.llm.segments import SegmentTable

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class ByteTokens:
    """Ids of a byte-level BPE vocabulary given as ranks, for batches of texts.

    A token never goes over a single space between two other characters, so the parts between spaces are encoded once
    and remembered. ``added`` holds tokens that are cut out of a text before all else, with their ids.
    """

    def __init__(self, ranks_path: str, pattern: str, added: dict[str, int]) -> None:
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)
        self.added = list(added)
        self.table = SegmentTable(self._rows, 1, ["", " "])
        self.first, self.rest = self.table.indexes
        self.stops, self.line_ends, self.opens = (np.zeros(max(*ranks.values(), *added.values()) + 1, bool) for _ in range(3))
        for token, i in ranks.items():
            self.stops[i] = token[-1:] in (b".", b"!", b"?")
            self.line_ends[i] = token[-1:] == b"\n"
            self.opens[i] = token[:1] in (b" ", b"\n")

    def _rows(self, parts: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
        found = [self.encoding.encode(p, allowed_special="all") for p in parts]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return lengths, [np.fromiter(chain.from_iterable(found), np.int32, int(lengths.sum()))]

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids, and how many each text has."""
        self.table.begin()
        first, rest = self.first, self.rest.__getitem__
        # a run of spaces is a token of its own, and an added token ends what is before it, so texts with such stay whole
        split = [[t] if any(x in t for x in ("  ", *self.added)) else t.split(" ") for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        heads = np.cumsum(counts) - counts
        at = np.fromiter(map(rest, chain.from_iterable(parts[1:] for parts in split)), np.int64, int((counts - 1).sum()))
        at = np.insert(at, heads - np.arange(len(heads)), np.fromiter((first[parts[0]] for parts in split), np.int64, len(split)))
        n, (ids,) = self.table.gather(at)
        ends = np.concatenate([[0], np.cumsum(n)])[np.cumsum(counts)]
        return ids, np.diff(ends, prepend=0)


def choose_cuts(at: np.ndarray, penalty: np.ndarray, window: int, shortest: int = 64) -> list[int]:
    """The cuts, as positions in ``at``, of the cheapest way through all of the stream.

    ``at`` holds the places where a cut may be, ascending, from 0 to the stream's end, with no gap above ``window``.
    Windows of a power of two are tried from ``shortest`` on.
    """
    last = len(at) - 1
    # transitions that need no padding: (to, from) by binary search for each power of two
    to, come = [], []
    for k in range(shortest.bit_length() - 1, window.bit_length()):
        if (1 << k) < window:
            want = at - (1 << k)
            i = np.searchsorted(at, want)
            hit = np.flatnonzero((want >= 0) & (at[np.minimum(i, last)] == want))
            to.append(hit)
            come.append(i[hit])
    order = np.argsort(np.concatenate(to), kind="stable")
    to, come = np.concatenate(to)[order].tolist(), np.concatenate(come)[order].tolist()
    to.append(last + 1)
    places, cost = at.tolist(), penalty.tolist()
    f, back, key = [0.0] * (last + 1), [0] * (last + 1), [0.0] * (last + 1)
    queue, head, t = [0] * (last + 1), 0, 0
    size = 1
    for j in range(1, last + 1):
        here = places[j]
        low = here - window
        while places[queue[head]] < low:
            head += 1
        i = queue[head]
        best = window - here + key[i]
        while to[t] == j:
            h = come[t]
            if f[h] < best:
                best, i = f[h], h
            t += 1
        f[j] = best = best + cost[j]
        back[j] = i
        key[j] = k = best + here
        while size > head and key[queue[size - 1]] >= k:
            size -= 1
        queue[size] = j
        size += 1
    cuts, j = [last], last
    while j:
        j = back[j]
        cuts.append(j)
    return cuts[::-1]


class _Packer:
    def __init__(self, tokens: ByteTokens, window: int, sentence: float, word: float, grid: int, separator: int) -> None:
        self.tokens, self.window, self.sentence, self.word, self.grid, self.separator = tokens, window, sentence, word, grid, separator
        self.sequence = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36

    def block(self, doc_ids: list[int | None], texts: list[str]) -> pa.RecordBatch:
        ids, n = self.tokens.batch(texts)
        n = n + 1
        ends = np.cumsum(n)
        begins = ends - n
        stream = np.full(int(ends[-1]), self.separator, np.uint32)
        inside = np.ones(len(stream), bool)
        inside[ends - 1] = False
        stream[inside] = ids
        kind = np.full(len(stream) + 1, np.inf)
        kind[(np.arange(len(stream) + 1) % self.grid) == 0] = self.word
        before = stream[:-1]
        over = self.tokens.line_ends[before] | (self.tokens.stops[before] & self.tokens.opens[stream[1:]])
        kind[1:-1][over & inside[:-1]] = self.sentence
        kind[ends] = 0
        kind[0] = 0
        at = np.flatnonzero(np.isfinite(kind))
        cuts = at[choose_cuts(at, kind[at], self.window)]
        # pieces: the stream cut at windows and at documents
        bounds = np.union1d(cuts, np.concatenate([[0], ends]))
        left, size = bounds[:-1], np.diff(bounds)
        doc = np.searchsorted(ends, left, side="right")
        seq = np.searchsorted(cuts, left, side="right") - 1
        data = memoryview(stream.astype("<u4").tobytes())
        crc = [zlib.crc32(data[4 * a : 4 * (a + b)]) for a, b in zip(left.tolist(), size.tolist(), strict=True)]
        keys = pa.array(doc_ids, pa.int64()).take(pa.array(doc))
        columns = [keys, left - begins[doc], size, np.array(crc, np.int64), n[doc], self.sequence + seq, left - cuts[seq]]
        self.sequence += len(cuts) - 1
        names = [c.split()[0] for c in PIECES.split(", ")]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns], names=names)


def added_tokens(ranks_path: str) -> dict[str, int]:
    """The added tokens of the tokenizer's JSON file that lies beside its ranks; none without such a file."""
    path = Path(ranks_path).with_suffix(".json")
    return {t["content"]: t["id"] for t in json.loads(path.read_text())["added_tokens"]} if path.exists() else {}


def pack_documents(
    docs: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", window: int = 1024,
    sentence_penalty: float = 2, word_penalty: float = 6, grid: int = 64, separator: int = 0, block_chars: int = 600_000,
) -> DataFrame:
    """One row per piece: the part of a document that lies in one sequence.

    Columns: doc_id; start (ids of the document before it); length; ids_crc32 (of its ids as little-endian unsigned
    32-bit numbers); doc_tokens (ids of the document with the separator); sequence_id; offset (place in the sequence).
    """

    added = added_tokens(ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(ByteTokens(ranks_path, pattern, added), window, sentence_penalty, word_penalty, grid, separator)
        keys: list[int | None] = []
        texts: list[str] = []
        chars = 0
        for b in batches:
            own, more = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
            for i, j in slices(more, block_chars):
                keys += own[i:j]
                texts += more[i:j]
                chars += sum(map(len, more[i:j]))
                if chars >= block_chars:
                    yield packer.block(keys, texts)
                    keys, texts, chars = [], [], 0
        if keys:
            yield packer.block(keys, texts)

    return docs.select(doc_id, text).mapInArrow(run, PIECES)
