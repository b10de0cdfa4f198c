"""Pieces shared by the text operators: held-out split, shared folder, batch slicing, word shingles."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE_WORDS = 5
#: Characters of text that one step of a task works on; only memory depends on it.
SLICE_CHARS = 4_000_000


def held_out(doc_id: str = "doc_id") -> Column:
    """True for rows that no model may learn labels from; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def shared_folder(spark: SparkSession) -> str:
    """The session's folder for intermediate tables, which all executors share.

    Only a local session that has none gets a folder of its own; on a cluster that folder would not be shared.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith(("local[", "local-cluster[")) and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame, replaces: DataFrame | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again, which cuts its lineage.

    Small tables come back in few partitions. ``replaces`` is an earlier result of this function that nothing
    needs any more; its files go.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if replaces is not None:
        release(replaces)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete the files of results of ``cut`` that nothing needs any more."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.cut_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Inside, Spark deletes the shuffle files of a write as it ends, instead of when the driver's heap is collected."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(texts: list[str | None], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch that hold about ``limit`` characters each; every row is in exactly one."""
    first, chars = 0, 0
    for i, t in enumerate(texts):
        chars += len(t or "")
        if chars >= limit:
            yield first, i + 1
            first, chars = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def list_array(values: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    """An Arrow list column from flat values and the length of each list."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    """xxh64 of a word, remembered; forgotten as a whole when many words are held, which changes no value."""

    MOST = 1_000_000

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) < self.MOST and len(word) < 64:
            self[word] = value
        return value


class Shingler:
    """Distinct word-shingle hashes of whole texts.

    Words are runs of anything but ASCII white space, with A-Z lower-cased. A text with fewer words than a
    shingle has its whole sequence as one shingle; a text without words has none.
    """

    FACTOR = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, words: int = SHINGLE_WORDS) -> None:
        self.words, self.hashes = words, _WordHashes()

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        """For each text, its sorted distinct 64-bit shingle hashes."""
        return [np.unique(s) for s in self.sequences(texts)]

    def sequences(self, texts: list[str | None]) -> list[np.ndarray]:
        """For each text, the 64-bit hashes of its shingles, one after the other."""
        if len(self.hashes) >= _WordHashes.MOST:
            self.hashes.clear()
        split = [(t or "").encode().lower().split() for t in texts]
        lengths = np.fromiter(map(len, split), np.int64, len(split))
        total, k, get = int(lengths.sum()), self.words, self.hashes.__getitem__
        flat = np.fromiter((h for ws in split for h in map(get, ws)), np.uint64, total)
        rolled = flat[: max(0, total - k + 1)].copy()
        for j in range(1, k):
            rolled = rolled * self.FACTOR + flat[j : total - k + 1 + j]
        rolled, ends, out = mix64(rolled), np.cumsum(lengths), []
        for n, end in zip(lengths.tolist(), ends.tolist(), strict=True):
            if n >= k:
                out.append(rolled[end - n : end - k + 1])
            elif n:
                h = np.uint64(n)
                with np.errstate(over="ignore"):
                    for w in flat[end - n : end]:
                        h = h * self.FACTOR + w
                out.append(mix64(np.array([h], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
        return out
