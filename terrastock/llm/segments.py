"""Encodings of recurring text segments, gathered as arrays.

A tokenizer whose pieces never cross certain boundaries may encode the segments between them one by one. Most
segments of a corpus recur, so a task keeps those it has met in flat arrays and builds the ids of a whole batch of
texts with a few array operations.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np


class _Index(dict):
    def __init__(self, table: SegmentTable, prefix: str) -> None:
        super().__init__()
        self.table, self.prefix = table, prefix

    def __missing__(self, part: str) -> int:
        self[part] = at = self.table.known + len(self.table.pending)
        self.table.pending.append(self.prefix + part)
        self.table.chars += len(part)
        return at


class SegmentTable:
    """Rows of numbers for each segment, computed once by ``encode`` for many new segments at a time.

    ``encode`` takes segments and returns how many numbers each of them has, and for each column all numbers in order.
    Memory is bounded: beyond ``most_chars`` of held segments the table starts anew.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, list[np.ndarray]]], columns: int, prefixes: Sequence[str], most_chars: int = 12_000_000) -> None:
        self.encode, self.columns, self.most = encode, columns, most_chars
        self.indexes = [_Index(self, p) for p in prefixes]
        self._reset()

    def _reset(self) -> None:
        for x in self.indexes:
            x.clear()
        self.known, self.chars, self.pending = 0, 0, []
        self.starts, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = [np.zeros(0, np.int32) for _ in range(self.columns)]

    def begin(self) -> None:
        """Call before the segments of a new batch are looked up."""
        if self.chars > self.most:
            self._reset()

    def _flush(self) -> None:
        if not self.pending:
            return
        lengths, columns = self.encode(self.pending)
        base = len(self.flat[0])
        self.starts = np.concatenate([self.starts, base + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.flat = [np.concatenate([f, c.astype(np.int32)]) for f, c in zip(self.flat, columns, strict=True)]
        self.known += len(lengths)
        self.pending = []

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """For looked-up segments: how many numbers each has, and for each column all numbers in order."""
        self._flush()
        n = self.lengths[at]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        where = np.repeat(self.starts[at] - (ends - n), n) + np.arange(total)
        return n, [column[where] for column in self.flat]
