"""Document quality by attention-based multiple-instance learning (operator 10).

A document is a bag of passages. Every passage of the whole text is encoded (shares of character classes, of their
pairs and of hashed byte trigrams, through a learned layer); gated attention, learned from labels of documents alone, weighs the passages; the
weighted passage representation is scored.

The model is fitted on a bounded sample of labelled rows: at most ``sample`` of them, those with the smallest hashes of
their ids, as long as they have ``passages`` passages or fewer together; of a document in it, all passages count. These
bounds hold for fitting only. Scoring is a narrow transformation over all documents and whole texts.

Defined results: null and empty texts are one empty passage and get a score like any other; repeated rows score
alike; of several labels of a document the largest counts, null labels none; without labels of both kinds every score
is the share of good labels (0.5 without labels); extra columns pass through; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrastock.llm.common import slices

PASSAGE_BYTES = 600
#: Classes of bytes, in order; bytes above 127 are one more class, all others the last.
CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n\r\t", ".", ",", "!?", "'\"()[]{}", "-_", "*#$%&@^~`", "|/\\", ":;=<>+")
N_CLASSES = len(CLASSES) + 2
TRIGRAMS = 256
WIDTH = N_CLASSES * (N_CLASSES + 1) + TRIGRAMS + 1


def _byte_classes() -> np.ndarray:
    table = np.full(256, N_CLASSES - 1, np.int64)
    table[128:] = N_CLASSES - 2
    for k, chars in enumerate(CLASSES):
        table[list(chars.encode())] = k
    return table


_CLASS_OF = _byte_classes()


def passage_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of some texts, and how many passages each text has."""
    data = [(t or "").encode() for t in texts]
    size = np.fromiter(map(len, data), np.int64, len(data))
    counts = np.maximum(1, -(-size // PASSAGE_BYTES))
    begin = np.cumsum(size) - size
    first = np.cumsum(counts) - counts
    total, n = int(size.sum()), int(counts.sum())
    raw = np.frombuffer(b"".join(data), np.uint8)
    kind = _CLASS_OF[raw]
    passage = np.repeat(first, size) + (np.arange(total) - np.repeat(begin, size)) // PASSAGE_BYTES
    single = np.bincount(passage * N_CLASSES + kind, minlength=n * N_CLASSES).reshape(n, N_CLASSES)
    pair = kind[:-1] * N_CLASSES + kind[1:]
    inside = np.ones(max(0, total - 1), bool)
    ends = np.cumsum(size)[:-1] - 1
    inside[ends[(ends >= 0) & (ends < total - 1)]] = False
    pairs = np.bincount((passage[:-1] * N_CLASSES**2 + pair)[inside], minlength=n * N_CLASSES**2).reshape(n, N_CLASSES**2)
    three = raw.astype(np.uint32)
    three = (three[:-2] * np.uint32(0x9E3779B1) ^ three[1:-1] * np.uint32(0x85EBCA77) ^ three[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(24)
    grams = np.bincount((passage[:-2] * TRIGRAMS + three)[inside[:-1] & inside[1:]], minlength=n * TRIGRAMS).reshape(n, TRIGRAMS)
    length = np.maximum(1, single.sum(axis=1, keepdims=True))
    return np.concatenate([*(np.sqrt(x / length) for x in (single, pairs, grams)), length / PASSAGE_BYTES], axis=1, dtype=np.float32), counts


@dataclass
class AttentionModel:
    """Weights: encoder (mean, scale, w, b), attention (v, u, a) and score (c, d)."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray
    v: np.ndarray
    u: np.ndarray
    a: np.ndarray
    c: np.ndarray
    d: np.ndarray

    def forward(self, x: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        """All steps from standardised passages to the logits of their documents."""
        starts = np.cumsum(counts) - counts
        h = np.tanh(x @ self.w + self.b)
        t, g = np.tanh(h @ self.v), 1 / (1 + np.exp(-(h @ self.u)))
        e = (t * g) @ self.a
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), counts))
        attention = e / np.repeat(np.add.reduceat(e, starts), counts)
        z = np.add.reduceat(attention[:, None] * h, starts, axis=0)
        return {"starts": starts, "h": h, "t": t, "g": g, "attention": attention, "z": z, "logit": z @ self.c + self.d}

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x, counts = passage_features(texts)
        return 1 / (1 + np.exp(-self.forward((x - self.mean) * self.scale, counts)["logit"].astype(np.float64)))


def fit(x: np.ndarray, counts: np.ndarray, good: np.ndarray, hidden: int = 24, gates: int = 12, steps: int = 150, rate: float = 0.02, decay: float = 1e-4, seed: int = 7) -> AttentionModel:
    """Adam on the log loss of documents, both kinds weighing alike."""
    rng = np.random.default_rng(seed)
    mean, deviation = x.mean(axis=0), x.std(axis=0)
    scale = (1 / np.maximum(deviation, 0.02)).astype(np.float32)
    x = (x - mean) * scale
    draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    m = AttentionModel(mean, scale, draw(x.shape[1], hidden), np.zeros(hidden, np.float32), draw(hidden, gates), draw(hidden, gates), draw(gates), draw(hidden), np.zeros((), np.float32))
    y = good.astype(np.float32)
    weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())).astype(np.float32)
    names = ("w", "b", "v", "u", "a", "c", "d")
    first, second = ({k: np.zeros_like(getattr(m, k)) for k in names} for _ in range(2))
    for step in range(1, steps + 1):
        o = m.forward(x, counts)
        h, t, g, attention = o["h"], o["t"], o["g"], o["attention"]
        error = weight * (1 / (1 + np.exp(-o["logit"])) - y)
        per = np.repeat(error, counts)
        toward = h @ m.c  # what the score gains from a passage
        mixed = np.add.reduceat(attention * toward, o["starts"])
        slope = per * attention * (toward - np.repeat(mixed, counts))
        gate = slope[:, None] * m.a
        dt, dg = gate * g * (1 - t * t), gate * t * g * (1 - g)
        dh = (per * attention)[:, None] * m.c + dt @ m.v.T + dg @ m.u.T
        dh *= 1 - h * h
        grads = {"w": x.T @ dh + decay * m.w, "b": dh.sum(axis=0), "v": h.T @ dt, "u": h.T @ dg, "a": (t * g).T @ slope, "c": o["z"].T @ error + decay * m.c, "d": error.sum()}
        for k in names:
            first[k] = 0.9 * first[k] + 0.1 * grads[k]
            second[k] = 0.999 * second[k] + 0.001 * grads[k] ** 2
            move = rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
            setattr(m, k, (getattr(m, k) - move).astype(np.float32))
    return m


def train_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = 2000, passages: int = 50_000) -> AttentionModel | float:
    """Fit on a bounded sample of labelled documents. ``labels`` must hold only rows that may be learned from.

    The sample's ids (at most ``sample`` of them) go to every task; its passages come to the driver, at most
    ``passages`` rows of 4 * ``WIDTH`` bytes. A document that would go beyond that is left out whole, and no other one.
    Without labels of both kinds: the share of good ones.
    """
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
        .groupBy(F.col(doc_id).alias("__id"))
        .agg(F.max(label).cast("int").alias("__label"))
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(sample)
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, marks, texts = (b.column(i).to_pylist() for i in range(3))
            for i, j in slices(texts):
                x, counts = passage_features(texts[i:j])
                bags = np.split(x, np.cumsum(counts)[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(ids[i:j], pa.int64()), pa.array(marks[i:j], pa.int32()), pa.array([v.tobytes() for v in bags], pa.binary())], names=["id", "label", "x"])

    joined = docs.select(F.col(doc_id).cast("long").alias("__id"), F.col(text).alias("__text")).join(F.broadcast(chosen), "__id")
    size = F.greatest(F.lit(1), F.ceil(F.octet_length(F.coalesce("__text", F.lit(""))) / PASSAGE_BYTES))
    sizes = joined.groupBy("__id").agg(F.sum(size).alias("n")).orderBy(F.xxhash64("__id"), "__id").collect()
    taken, left = [], passages
    for r in sizes:
        if r["n"] <= left:
            taken.append(r["__id"])
            left -= r["n"]
    rows = joined.where(F.col("__id").isin(taken)).select("__id", "__label", "__text").mapInArrow(encode, "id long, label int, x binary").collect()
    rows = sorted({(r["id"], bytes(r["x"])): r["label"] for r in rows}.items())
    good = np.array([label for _, label in rows])
    if len(set(good.tolist())) < 2:
        return float(good.mean()) if len(good) else 0.5
    bags = [np.frombuffer(k[1], np.float32).reshape(-1, WIDTH) for k, _ in rows]
    return fit(np.concatenate(bags), np.array([len(x) for x in bags]), good)


def score_quality(docs: DataFrame, model: AttentionModel | float, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with ``score``: from 0 to 1, higher where a good label is likelier."""
    if isinstance(model, float):
        return docs.withColumn(score, F.lit(model))
    columns = [c for c in docs.columns if c != score]
    schema = T.StructType([*(f for f in docs.schema.fields if f.name != score), T.StructField(score, T.DoubleType())])
    place = columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(place).to_pylist()
            made = [model.scores(texts[i:j]) for i, j in slices(texts, 1_000_000)]
            if made:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(made))], names=schema.names)

    return docs.select(*(F.col(f"`{c}`") for c in columns)).mapInArrow(run, schema)
