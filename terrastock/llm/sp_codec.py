"""SentencePiece encoding with original byte spans, and decoding (operator 3).

``encode_documents`` normalises a text by longest-prefix replacement through the model's compiled character map (a
model without one keeps every character), keeping for every normalised character the original bytes it stands for;
merges its segments into pieces, best pair first, many segments at a time by array operations; and projects every
piece through that alignment to a span of the original UTF-8 bytes. ``decode_documents`` turns ids into text. The
sentencepiece library reads the model's file only; the tests hold ids, spans and texts against it.

Defined results: a null text counts as empty; an empty text has no ids and decodes to an empty text; repeated rows
are encoded alike; other columns pass through; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrastock.llm.common import list_array, slices
from terrastock.llm.segments import SegmentTable

SPACE = "▁"
#: Ids that one step of decoding works on; only memory depends on it.
SLICE_IDS = 200_000


class CharacterMap:
    """The compiled map of a model: a double-array trie over UTF-8 bytes, and the replacements its leaves point at."""

    def __init__(self, blob: bytes) -> None:
        size = struct.unpack_from("<I", blob)[0]
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
        self.replacements = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """The longest mapped prefix of ``data[at:]``: how many bytes it takes, and what stands for it."""
        units, found, node = self.units, None, 0
        unit = units[0]
        node = (unit >> 10) << ((unit & 0x200) >> 6)
        for i in range(at, len(data)):
            byte = data[i]
            node ^= byte
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != byte:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit & 0x100:
                found = i + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        end = self.replacements.index(b"\0", found[1])
        return found[0], self.replacements[found[1] : end]


class PieceModel:
    """A BPE piece model read from its file."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        if proto.trainer_spec.model_type != 2:
            raise ValueError("only BPE models are supported")
        if any(p.type in (4, 5) for p in proto.pieces):
            raise ValueError("models with user-defined or unused pieces are not supported")
        spec = proto.normalizer_spec
        self.dummy_prefix, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.map = CharacterMap(spec.precompiled_charsmap) if spec.precompiled_charsmap else None
        self.score = {p.piece: p.score for p in proto.pieces if p.type == 1}
        self.id = {p.piece: i for i, p in enumerate(proto.pieces)}
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == 2)
        self.bytes = [self.id.get(f"<0x{b:02X}>") for b in range(256)]
        self.byte_fallback = proto.trainer_spec.byte_fallback
        self.piece = [p.piece for p in proto.pieces]
        # what an id decodes to, and whether it is one raw byte
        surface = [p.piece.replace(SPACE, " ").encode() if p.type == 1 else b"" for p in proto.pieces]
        for b, i in enumerate(self.bytes):
            if i is not None:
                surface[i] = bytes([b])
        surface[self.unknown] = proto.trainer_spec.unk_surface.encode()
        self.surface_at = np.cumsum([0, *map(len, surface)])
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.starts_with_space = np.array([p.type == 1 and p.piece.startswith(SPACE) for p in proto.pieces])
        #: No piece continues over the start of a word, so words can be encoded one by one.
        self.by_word = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.score)
        # ids of single characters, and all pairs of pieces whose merge is a piece, with its id
        single = sorted((ord(p), self.id[p]) for p in self.score if len(p) == 1)
        self.char, self.char_id = (np.array(x, np.int64) for x in zip(*single, strict=True))
        pairs = sorted((self.id[p[:k]] << 32 | self.id[p[k:]], self.id[p]) for p in self.score for k in range(1, len(p)) if p[:k] in self.score and p[k:] in self.score)
        self.pair, self.pair_id = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        self.id_score = np.array([p.score for p in proto.pieces], np.float32)

    def normalise(self, text: str) -> tuple[str, list[int], list[int]]:
        """The normalised text with, for each of its characters, the original bytes it stands for: start and end.

        Of characters that one replacement put in, the last stands for the bytes; bytes that were taken out belong to
        the character before them.
        """
        data, out, begin, at = text.encode(), [], [], 0
        while at < len(data):
            hit = self.map.longest(data, at) if self.map else None
            if hit:
                took, put = hit[0], hit[1].decode()
            else:
                lead = data[at]
                took = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                put = data[at : at + took].decode()
            out.extend(put)
            begin.extend([at] * len(put))
            at += took
        if self.squeeze:
            keep = [i for i, c in enumerate(out) if c != " " or (i and out[i - 1] != " ")]
            while keep and out[keep[-1]] in (" ", SPACE):
                at = begin[keep.pop()]
            out, begin = ([x[i] for i in keep] for x in (out, begin))
        out = [SPACE if c == " " else c for c in out]
        if self.dummy_prefix and out:
            out, begin = [SPACE, *out], [begin[0], *begin]
        return "".join(out), begin, [*begin[1:], at] if begin else []

    def pieces(self, text: str) -> list[str]:
        """Merge the best-scored neighbours first, leftmost among equals, until no merge is a piece."""
        symbols, score = list(text), self.score
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(-score[w], i, len(w)) for i in range(n - 1) if (w := symbols[i] + symbols[i + 1]) in score]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            left = symbols[i]
            j = after[i]
            if not left or j >= n or len(left) + len(symbols[j]) != size:
                continue
            symbols[i], symbols[j] = left + symbols[j], ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (w := symbols[i] + symbols[k]) in score:
                    heapq.heappush(heap, (-score[w], i, len(w)))
            if (h := before[i]) >= 0 and (w := symbols[h] + symbols[i]) in score:
                heapq.heappush(heap, (-score[w], h, len(w)))
        return [s for s in symbols if s]

    def encode(self, normalised: str) -> tuple[list[int], list[int]]:
        """Ids, and how many characters each stands for; of the bytes of a character the last stands for it."""
        ids, chars = [], []
        for p in self.pieces(normalised):
            if p in self.score:
                ids.append(self.id[p])
                chars.append(len(p))
            elif self.byte_fallback:
                for c in p:
                    data = c.encode()
                    ids.extend(self.bytes[b] for b in data)
                    chars.extend([0] * (len(data) - 1) + [1])
            elif ids and ids[-1] == self.unknown:  # a run of unknown characters is one piece
                chars[-1] += len(p)
            else:
                ids.append(self.unknown)
                chars.append(len(p))
        return ids, chars

    def _merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of the pieces that pairs of ids merge into, or -1."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where((self.pair[at] == key) & (left >= 0) & (right >= 0), self.pair_id[at], -1)

    def merge_segments(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which segment each piece belongs to, its id (-1 for a character that is none), and its characters.

        All segments take one merge at a time, each the one that ``pieces`` would do next.
        """
        sizes = np.fromiter(map(len, segments), np.int64, len(segments))
        code = np.frombuffer("".join(segments).encode("utf-32-le"), "<u4").astype(np.int64)
        at = np.minimum(np.searchsorted(self.char, code), len(self.char) - 1)
        sym, seg, width = np.where(self.char[at] == code, self.char_id[at], -1), np.repeat(np.arange(len(segments)), sizes), np.ones(len(code), np.int64)
        none = np.float32(-np.inf)

        def judged(i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """What the symbols at ``i`` merge into with those after them, and how good that is."""
            j = np.minimum(i + 1, len(sym) - 1)
            to = np.where((j > i) & (seg[i] == seg[j]), self._merged(sym[i], sym[j]), -1)
            return to, np.where(to >= 0, self.id_score[to], none)

        to, good = judged(np.arange(len(sym)))
        done = []
        while len(sym):
            starts = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
            counts = np.diff(np.append(starts, len(seg)))
            best = np.repeat(np.maximum.reduceat(good, starts), counts)
            over = best == none
            if over.any():
                done.append((seg[over], sym[over], width[over]))
                sym, seg, width, to, good, best = (x[~over] for x in (sym, seg, width, to, good, best))
                if not len(sym):
                    break
            hit = np.flatnonzero(good == best)
            hit = hit[np.concatenate([[True], seg[hit][1:] != seg[hit][:-1]])]  # the leftmost of each segment
            sym[hit] = to[hit]
            width[hit] += width[hit + 1]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            sym, seg, width, to, good = (x[keep] for x in (sym, seg, width, to, good))
            hit -= np.arange(len(hit))
            changed = np.concatenate([hit, hit[hit > 0] - 1])
            to[changed], good[changed] = judged(changed)
        seg, sym, width = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (np.zeros(0, np.int64),) * 3
        o = np.argsort(seg, kind="stable")
        return seg[o], sym[o], width[o]

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> list[str]:
        """The text of each run of ids; the space that encoding put in front is taken off."""
        ends = np.cumsum(lengths)
        size = (self.surface_at[1:] - self.surface_at[:-1])[ids]
        to = np.cumsum(size)
        total = int(to[-1]) if len(to) else 0
        data = self.surface[np.repeat(self.surface_at[ids] - (to - size), size) + np.arange(total)].tobytes()
        bound = np.concatenate([[0], to])
        out = []
        for end, n in zip(ends.tolist(), lengths.tolist(), strict=True):
            a, b = int(bound[end - n]), int(bound[end])
            if n and self.dummy_prefix and self.starts_with_space[ids[end - n]]:
                a += 1
            out.append(data[a:b].decode("utf-8", "replace"))
        return out


class _Encoder:
    """Ids and byte spans of batches of texts, with segments remembered between batches."""

    #: Longer segments are merged one by one, with a heap.
    SHORT = 48

    def __init__(self, path: str) -> None:
        self.model = PieceModel(path)
        self.table = SegmentTable(self._rows, 2, [SPACE, ""], most_chars=3_000_000)
        self.words, self.raw = self.table.indexes
        self.runs = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")

    def _rows(self, segments: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
        """How many ids each segment has, and all ids with the characters that each stands for."""
        m = self.model
        short = np.fromiter((len(s) <= self.SHORT and m.byte_fallback for s in segments), bool, len(segments))
        few = [s for s, x in zip(segments, short.tolist(), strict=True) if x]
        seg, sym, chars = m.merge_segments(few)
        if (sym < 0).any():  # a character that is no piece: its bytes, of which the last stands for it
            code = np.frombuffer("".join(few).encode("utf-32-le"), "<u4")[np.cumsum(chars) - chars]
            size = np.where(sym < 0, 1 + (code >= 0x80) + (code >= 0x800).astype(int) + (code >= 0x10000), 1)
            ends = np.cumsum(size)
            spread, whole = np.repeat(np.arange(len(sym)), size), sym >= 0
            data = np.frombuffer("".join(map(chr, code[~whole])).encode(), np.uint8)
            ids, out = sym[spread], np.zeros(len(spread), np.int64)
            ids[~whole[spread]] = np.array([-1 if b is None else b for b in m.bytes])[data]
            out[ends - 1] = chars
            seg, sym, chars = seg[spread], ids, out
        place = np.flatnonzero(short)
        lengths = np.zeros(len(segments), np.int64)
        lengths[place] = np.bincount(seg, minlength=len(few))
        if short.all():
            return lengths, [sym, chars]
        # the others, put in between
        ids, counts, bounds = [], [], np.cumsum(lengths)
        for k, s in enumerate(segments):
            if short[k]:
                own = slice(int(bounds[k] - lengths[k]), int(bounds[k]))
                ids.append(sym[own])
                counts.append(chars[own])
            else:
                own_ids, own_chars = m.encode(s)
                lengths[k] = len(own_ids)
                ids.append(np.array(own_ids, np.int64))
                counts.append(np.array(own_chars, np.int64))
        return lengths, [np.concatenate(ids), np.concatenate(counts)]

    def _aligned(self, texts: list[str]) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
        """The segments of each normalised text, and the original bytes that each of its characters stands for.

        Segments of a text that starts with no space and has no two in a row come without their leading sign.
        """
        m = self.model
        if m.map or m.squeeze or not m.dummy_prefix:
            made = [m.normalise(t) for t in texts]
            begin, end = (np.fromiter((v for x in made for v in x[k]), np.int32, sum(len(x[k]) for x in made)) for k in (1, 2))
            return [self.runs.findall(x[0]) if m.by_word else [x[0]] * bool(x[0]) for x in made], begin, end
        # without a map each character stands for itself, and the space put in front for nothing
        full = [t for t in texts if t]
        code = np.frombuffer("".join(SPACE + t for t in full).encode("utf-32-le"), "<u4")
        size = (1 + (code >= 0x80) + (code >= 0x800).astype(np.int64) + (code >= 0x10000)).astype(np.int64)
        chars = np.fromiter((len(t) + 1 for t in full), np.int64, len(full))
        size[np.cumsum(chars) - chars] = 0
        end = np.cumsum(size)
        end -= np.repeat(end[np.cumsum(chars) - chars], chars)
        found = [[] if not t else self.runs.findall(SPACE + t.replace(" ", SPACE)) if not m.by_word or self._odd(t) else t.split(" ") for t in texts]
        return found if m.by_word else [["".join(x)] * bool(x) for x in found], (end - size).astype(np.int32), end.astype(np.int32)

    def _odd(self, t: str) -> bool:
        return t[0] == " " or "  " in t or SPACE in t

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids, span starts and span ends, and how many ids each text has."""
        self.table.begin()
        m, word, raw = self.model, self.words.__getitem__, self.raw.__getitem__
        bare = m.by_word and not (m.map or m.squeeze) and m.dummy_prefix
        found, begin, end = self._aligned(texts)
        counts = np.fromiter(map(len, found), np.int64, len(found))
        at = [np.fromiter(map(word if bare and t and not self._odd(t) else raw, parts), np.int64, len(parts)) for t, parts in zip(texts, found, strict=True)]
        n, (ids, chars) = self.table.gather(np.concatenate([np.zeros(0, np.int64), *at]))
        lengths = np.diff(np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(counts)])])
        stop = np.cumsum(chars, dtype=np.int64)
        starts = begin[np.minimum(stop - chars, len(begin) - 1)] if len(begin) else np.zeros(0, np.int32)
        stops = np.where(chars > 0, end[np.maximum(stop, 1) - 1], starts) if len(end) else np.zeros(0, np.int32)
        return ids.astype(np.int32), starts.astype(np.int32), stops.astype(np.int32), lengths


def encode_documents(docs: DataFrame, model_path: str, text: str = "text", spans: bool = True) -> DataFrame:
    """``docs`` with ``ids`` and, if ``spans``, ``span_start`` and ``span_end``: arrays with one entry per piece.

    Spans are half-open, in bytes of the UTF-8 text. A narrow transformation: no shuffle, memory by batch slice.
    ``model_path`` must be readable on every executor.
    """
    names = ["ids", "span_start", "span_end"] if spans else ["ids"]
    kept = [f for f in docs.schema.fields if f.name not in names]
    schema = T.StructType([*kept, *(T.StructField(n, T.ArrayType(T.IntegerType(), False)) for n in names)])
    columns = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _Encoder(model_path)
        for b in batches:
            texts = [t or "" for t in b.column(columns.index(text)).to_pylist()]
            for i, j in slices(texts, 400_000):
                ids, starts, stops, lengths = encoder.batch(texts[i:j])
                made = [list_array(x, lengths) for x in ((ids, starts, stops) if spans else (ids,))]
                yield pa.RecordBatch.from_arrays([*b.slice(i, j - i).columns, *made], names=[*columns, *names])

    return docs.select(*(F.col(f"`{c}`") for c in columns)).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, model_path: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``: the text of its ids. Null ids decode to an empty text."""
    schema = T.StructType([*(f for f in encoded.schema.fields if f.name != "decoded"), T.StructField("decoded", T.StringType())])
    columns = schema.names[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel(model_path)
        for b in batches:
            lengths = b.column(columns.index(ids)).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            part = np.cumsum(lengths) // SLICE_IDS  # about so many ids at a time
            bounds = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
            for i, j in zip(bounds, bounds[1:], strict=False):
                rows = b.slice(i, j - i)
                texts = model.decode(rows.column(columns.index(ids)).flatten().to_numpy(zero_copy_only=False), lengths[i:j])
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(texts, pa.string())], names=schema.names)

    return encoded.select(*(F.col(f"`{c}`") for c in columns)).mapInArrow(run, schema)
