"""Language identification by multilingual mixture inference (operator 1).

Each language is a model of letter trigrams. A document is a mixture of languages: every word comes from one of them,
expectation-maximisation estimates the shares from the words' trigram likelihoods, and the set of languages is the one
with the best penalised likelihood, among the likeliest one, two, ... of all.

Trigram counts are taken over all documents to learn from, as one small table for each language in each task, and
summed in Spark; the model (languages times ``BUCKETS`` numbers) is bounded and goes to every task. Inference is a
narrow transformation over whole texts.

Defined results: ``und`` with score 0 and no shares where the text is null or has no letter, or nothing could be
learned; ties go to the language first by name; repeated rows get equal results; extra columns pass through; an empty
table gives an empty table.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrastock.llm.common import slices

BUCKETS = 1 << 14
#: What one more language in a document must gain in log likelihood, times the logarithm of its words.
PENALTY = 3.0
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def _grams(token: str) -> list[int]:
    """Buckets of the trigrams of a token's letters, with marks at both ends; none without letters."""
    word = _NOT_LETTERS.sub("", token)
    if not word or not (word.isascii() or any(map(str.isalpha, word))):  # other signs of words, such as ², are no letters
        return []
    word = f"<{word}>"
    return [zlib.crc32(word[i : i + 3].encode()) % BUCKETS for i in range(len(word) - 2)]


class _Words(dict):
    """Tokens met so far, numbered; forgotten as a whole when they are many."""

    MOST = 6_000_000

    def __init__(self) -> None:
        super().__init__()
        self.new: list[list[int]] = []
        self.held = self.chars = 0

    def __missing__(self, token: str) -> int:
        self[token] = at = self.held + len(self.new)
        self.new.append(_grams(token))
        self.chars += len(token)
        return at

    def begin(self) -> bool:
        if self.chars > self.MOST:
            self.clear()
            self.held = self.chars = 0
            return True
        return False

    def numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
        """Numbers of all tokens, how many each text has, and the trigrams of those first met here."""
        split = [(t or "").lower().split() for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        get = self.__getitem__
        at = np.fromiter((n for tokens in split for n in map(get, tokens)), np.int64, int(counts.sum()))
        new, self.new = self.new, []
        self.held += len(new)
        return at, counts, new


def learn_languages(docs: DataFrame, text: str = "text", lang: str = "lang", smoothing: float = 0.1) -> tuple[list[str], np.ndarray]:
    """Names of the languages and log probabilities, languages by ``BUCKETS``. Rows with a null lang teach nothing."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, totals = _Words(), {}
        for b in batches:
            texts, langs = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, j in slices(texts):
                words.begin()
                at, counts, new = words.numbers(texts[i:j])
                if words.held == len(new):
                    flat, bounds = np.zeros(0, np.int64), np.zeros(1, np.int64)
                lengths = np.fromiter(map(len, new), np.int64, len(new))
                flat = np.concatenate([flat, np.fromiter((g for gs in new for g in gs), np.int64, int(lengths.sum()))])
                bounds = np.concatenate([bounds, bounds[-1] + np.cumsum(lengths)])
                of = np.repeat(np.arange(i, j), counts)
                for name in sorted(set(langs[i:j])):
                    rows = np.array([x == name for x in langs])
                    times = np.bincount(at[rows[of]], minlength=words.held)
                    table = totals.setdefault(name, np.zeros(BUCKETS))
                    table += np.bincount(flat, weights=np.repeat(times, np.diff(bounds)), minlength=BUCKETS)
        for name, table in totals.items():
            where = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(where), pa.string()), pa.array(where.astype(np.int32)), pa.array(table[where].astype(np.int64))], names=["lang", "bucket", "n"])

    counted = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(text, lang).mapInArrow(count, "lang string, bucket int, n long")
    rows = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    names = sorted({r["lang"] for r in rows})
    table = np.zeros((len(names), BUCKETS))
    for r in rows:
        table[names.index(r["lang"]), r["bucket"]] = r["n"]
    table += smoothing
    return names, np.log(table / table.sum(axis=1, keepdims=True)) if names else table


def mixture_shares(words: np.ndarray, counts: np.ndarray, steps: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Shares of each language in each document, and the best single language's posterior.

    ``words``: log likelihoods, words by languages; ``counts``: words of each document, all above 0.
    """
    n_docs, n_langs = len(counts), words.shape[1]
    starts = np.cumsum(counts) - counts
    alone = np.add.reduceat(words, starts, axis=0, dtype=np.float64)
    posterior = np.exp(alone - alone.max(axis=1, keepdims=True))
    posterior /= posterior.sum(axis=1, keepdims=True)
    top = words.max(axis=1, keepdims=True)
    p = np.exp(words - top)
    base = np.add.reduceat(top[:, 0], starts, dtype=np.float64)

    def em(docs: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shares and log likelihoods of some documents, with only the allowed languages in each."""
        own = counts[docs]
        begins = np.cumsum(own) - own
        rows = np.repeat(starts[docs] - begins, own) + np.arange(int(own.sum()))
        q, of = p[rows], np.repeat(np.arange(len(docs)), own)
        share = (allowed / allowed.sum(axis=1, keepdims=True)).astype(np.float32)
        for _ in range(steps):
            r = q * share[of]
            r /= r.sum(axis=1, keepdims=True) + 1e-30
            share = np.add.reduceat(r, begins, axis=0) / own[:, None]
        fit = np.log((q * share[of]).sum(axis=1) + 1e-30)
        return share, np.add.reduceat(fit, begins, dtype=np.float64) + base[docs]

    everything = np.arange(n_docs)
    shares, _ = em(everything, np.ones((n_docs, n_langs)))
    rank = np.argsort(-shares, axis=1, kind="stable")
    single = alone.argmax(axis=1)
    best = np.zeros((n_docs, n_langs))
    best[everything, single] = 1
    value = alone[everything, single]
    price = PENALTY * np.log(counts + 1)
    for k in range(2, n_langs + 1):
        docs = np.flatnonzero(shares[everything, rank[:, k - 1]] > 0.02)
        if not len(docs):
            break
        allowed = np.zeros((len(docs), n_langs))
        np.put_along_axis(allowed, rank[docs, :k], 1, axis=1)
        share, fit = em(docs, allowed)
        better = fit - (k - 1) * price[docs] > value[docs]
        value[docs[better]] = fit[better] - (k - 1) * price[docs[better]]
        best[docs[better]] = share[better]
    return best, posterior


def identify_languages(docs: DataFrame, names: list[str], table: np.ndarray, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (0 to 1: the share, times how sure the language is) and ``lang_shares``."""
    added = ["lang_pred", "score", "lang_shares"]
    kept = [f for f in docs.schema.fields if f.name not in added]
    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("lang_shares", T.ArrayType(T.DoubleType()))])
    columns = [f.name for f in kept]
    place, table = columns.index(text), table.T.astype(np.float32)

    def infer(words: _Words, known: list[np.ndarray], texts: list[str | None]) -> tuple[list, list, list]:
        if words.begin():
            known[:] = [known[0][:0], known[1][:0]]
        at, counts, new = words.numbers(texts)
        if new:
            lengths = np.fromiter(map(len, new), np.int64, len(new))
            flat = np.fromiter((g for gs in new for g in gs), np.int64, int(lengths.sum()))
            sums = np.zeros((len(new), len(names)), np.float32)
            full = lengths > 0
            if full.any():
                sums[full] = np.add.reduceat(table[flat], (np.cumsum(lengths) - lengths)[full], axis=0)
            known[:] = [np.concatenate([known[0], sums]), np.concatenate([known[1], full])]
        lettered = known[1][at]
        of = np.repeat(np.arange(len(texts)), counts)[lettered]
        own = np.bincount(of, minlength=len(texts))
        pred, score, shares = ["und"] * len(texts), [0.0] * len(texts), [None] * len(texts)
        rows = np.flatnonzero(own)
        if len(rows) and names:
            best, posterior = mixture_shares(known[0][at[lettered]], own[rows])
            which = best.argmax(axis=1)
            sure = best[np.arange(len(rows)), which] * (posterior[np.arange(len(rows)), which] + best.max(axis=1)) / 2
            for r, k, s, all_ in zip(rows.tolist(), which.tolist(), np.clip(sure, 0, 1).tolist(), best.tolist(), strict=True):
                pred[r], score[r], shares[r] = names[k], s, all_
        return pred, score, shares

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, known = _Words(), [np.zeros((0, len(names)), np.float32), np.zeros(0, bool)]
        for b in batches:
            texts = b.column(place).to_pylist()
            for i, j in slices(texts, 1_500_000):
                made = infer(words, known, texts[i:j])
                arrays = [pa.array(x, t) for x, t in zip(made, (pa.string(), pa.float64(), pa.list_(pa.float64())), strict=True)]
                yield pa.RecordBatch.from_arrays([*b.slice(i, j - i).columns, *arrays], names=schema.names)

    return docs.select(*(F.col(f"`{c}`") for c in columns)).mapInArrow(run, schema)
