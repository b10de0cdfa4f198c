"""The session's shared folder for intermediate tables: write, read again, release."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def use_shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for intermediate tables; only a local session without one gets a folder of its own."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and sc.master != "local" and not sc.master.startswith(("local[", "local-cluster[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


_noted = threading.local()


@contextmanager
def temporary() -> Iterator[list[DataFrame]]:
    """Inside, results of ``cut`` are noted in a list; at its end the files of those that are still in it go."""
    outer, made = getattr(_noted, "made", None), []
    _noted.made = made
    try:
        yield made
    finally:
        _noted.made = outer
        release(*made)


def cut(df: DataFrame, replaces: DataFrame | None = None) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again, which cuts its lineage and lets columns be pruned.

    ``replaces`` is an earlier result of this function that nothing needs any more; its files go.
    """
    spark = df.sparkSession
    path = f"{use_shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if replaces is not None:
        release(replaces)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    if getattr(_noted, "made", None) is not None:
        _noted.made.append(out)
    return out


def release(*frames: DataFrame) -> None:
    """Delete the files of results of ``cut`` that nothing needs any more."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.cut_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def task_count(df: DataFrame) -> int:
    """Into how many tasks heavy work on rows is dealt: the number of shuffle partitions, or of cores if that is more."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by keys to many tasks, before work on its rows that is heavy: a small file is one task otherwise."""
    return df if df.isStreaming else df.repartition(task_count(df), *keys)


def number_rows(df: DataFrame, order: list[str], name: str = "id", start: int = 0) -> DataFrame:
    """``df`` with places from ``start`` by ``order``, which must tell rows apart for the same numbers in every run.

    Rows are dealt into ranges and numbered inside them; only the ranges' sizes, one for each partition, meet in a task.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = cut(placed)
    part = F.shiftright("__at", 33)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    earlier = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    before = sizes.select("__part", F.coalesce(earlier, F.lit(0)).alias("__before"))
    own = F.col("__at").bitwiseAND(F.lit(2**33 - 1))
    return placed.withColumn("__part", part).join(F.broadcast(before), "__part").withColumn(name, own + F.col("__before") + F.lit(start)).drop("__part", "__at", "__before")
