"""Evaluation metrics, embedding classifiers and spatial statistics as aggregations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrastock.operators.shared import task_count


def confusion_matrix(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(label, prediction, n, share of the label's rows)."""
    counts = df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("label")))


def per_class_scores(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(cls, tp, fp, fn, recall, f1) from one pass: each row counts for its label and its prediction."""
    hit = F.col(label) == F.col(prediction)
    sides = F.array(F.struct(F.col(label).alias("cls"), F.lit(1).alias("is_label")), F.struct(F.col(prediction).alias("cls"), F.lit(0).alias("is_label")))
    rows = df.select(hit.alias("hit"), F.explode(sides).alias("s")).select("hit", "s.*")
    count = lambda c: F.coalesce(F.sum(F.when(c, 1)), F.lit(0)).cast("long")
    agg = rows.groupBy("cls").agg(
        count(F.col("hit") & (F.col("is_label") == 1)).alias("tp"), count(~F.col("hit") & (F.col("is_label") == 0)).alias("fp"), count(~F.col("hit") & (F.col("is_label") == 1)).alias("fn")
    )
    return agg.select("*", F.try_divide("tp", F.col("tp") + F.col("fn")).alias("recall"), (F.col("tp") / (F.col("tp") + 0.5 * (F.col("fp") + F.col("fn")))).alias("f1"))


def overall_scores(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row: accuracy, macro F1 and F1 weighted by the labels' counts."""
    per = per_class_scores(df, label, prediction)
    support = F.col("tp") + F.col("fn")
    return per.agg((F.sum("tp") / F.sum(support)).alias("accuracy"), F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * support) / F.sum(support)).alias("weighted_f1"))


def iou_by_class(df: DataFrame, label: str, prediction: str) -> DataFrame:
    per = per_class_scores(df, label, prediction)
    return per.select("cls", F.col("tp").alias("intersection"), (F.col("tp") + F.col("fp") + F.col("fn")).alias("union_"), (F.col("tp") / (F.col("tp") + F.col("fp") + F.col("fn"))).alias("iou"))


def _best_of_blocks(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Of rows (b, n, tag, query_id, vec_id, label, v) sorted by block, vectors before queries, each query's ``k`` best of the
    block. Products of matrices find those that can be among them; these are summed again term by term, in the order of
    the vectors, so that equal vectors are equally near wherever they lie."""
    block, held, bank, ids, rows = None, [], None, None, None
    for batch in batches:
        keys = np.column_stack([batch.column(c).to_numpy() for c in ("b", "n", "tag")])
        starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)]) if batch.num_rows else []
        for at, until in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            part, own = batch.slice(at, until - at), tuple(keys[at, :2])
            if own != block:
                block, held, bank = own, [], None
            if keys[at, 2] == 0:
                held.append(part)
                continue
            if not held:
                continue
            dim = int(own[1])
            if bank is None:
                rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                bank, ids = rows.column("v").flatten().to_numpy().reshape(-1, dim), rows.column("vec_id").to_numpy(zero_copy_only=False)
                order = np.argsort(ids, kind="stable")
                rows, bank, ids = rows.take(pa.array(order)), bank[order], ids[order]
            asked, names = part.column("v").flatten().to_numpy().reshape(-1, dim), part.column("query_id").to_numpy(zero_copy_only=False)
            found = []
            for first in range(0, len(asked), 256):
                some = asked[first : first + 256]
                sims = some @ bank.T
                sims[names[first : first + 256, None] == ids[None, :]] = -np.inf
                far = len(ids) - min(k, len(ids))
                least = np.partition(sims, far, axis=1)[:, far]
                # more than the rounding of a product's sum can be
                slack = 4e-16 * (dim + 4) * np.sqrt((some * some).sum(1)) * np.sqrt((bank * bank).sum(1).max())
                i, j = np.nonzero(~(sims < (least - 2 * slack)[:, None]) & (sims != -np.inf))
                exact = np.zeros(len(i))
                for d in range(dim):
                    exact += some[i, d] * bank[j, d]
                best = np.lexsort((j, -exact, i))
                i, j, exact = i[best], j[best], exact[best]
                place = np.arange(len(i)) - np.searchsorted(i, i)
                kept = place < k
                found.append(pa.RecordBatch.from_arrays([part.column("query_id").take(pa.array(i[kept] + first)), rows.column("vec_id").take(pa.array(j[kept])), rows.column("label").take(pa.array(j[kept])), pa.array(exact[kept])], ["query_id", "vec_id", "label", "sim"]))
            yield from found


def weighted_knn(queries: DataFrame, bank: DataFrame, k: int, sigma: float, blocks: int | None = None) -> DataFrame:
    """(query_id, label, score): classes by the weights exp(similarity / sigma) of the ``k`` largest inner products.

    ``queries``: (query_id, q); ``bank``: (vec_id, v, label). Queries are a stated set against all vectors, compared
    in blocks, by default of about 8,192 vectors and as many as partitions at least: the bank is dealt once, the queries
    go to every block, and each block keeps its own best. Vectors that are null or hold a null are left out, and only those of
    one length are compared.
    """
    blocks = blocks or max(int(bank.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-bank.count() // 8192))
    plain = lambda c: (F.col(c).isNotNull() & F.forall(c, lambda x: x.isNotNull()), F.col(c).cast("array<double>").alias("v"), F.size(c).alias("n"))
    (whole, v, n), (asked, q, m) = plain("v"), plain("q")
    held = bank.where(whole).select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("b"), n, F.lit(0).alias("tag"), F.lit(None).cast(queries.schema["query_id"].dataType).alias("query_id"), "vec_id", "label", v)
    types = {c: bank.schema[c].dataType for c in ("vec_id", "label")}
    sent = queries.where(asked).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")).alias("b"), m, F.lit(1).alias("tag"), "query_id", *(F.lit(None).cast(t).alias(c) for c, t in types.items()), q)
    both = held.unionByName(sent).repartition(task_count(bank), "b", "n").sortWithinPartitions("b", "n", "tag")
    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), *(T.StructField(c, t) for c, t in types.items()), T.StructField("sim", T.DoubleType())])
    pairs = both.mapInArrow(lambda batches: _best_of_blocks(batches, k), schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim"), "vec_id"))
    near = pairs.withColumn("r", rank).where(F.col("r") <= k)
    return near.groupBy("query_id", "label").agg(F.sum(F.exp(F.col("sim") / sigma)).alias("score"))


def mahalanobis(df: DataFrame, key: str, vector: str, ridge: float = 1e-9) -> DataFrame:
    """(key, m2): squared Mahalanobis distances to the mean, with the covariance divided by n.

    The sums behind mean and covariance (dimensions squared numbers) are aggregated in Spark and inverted here.
    """
    v = F.col(vector).cast("array<double>")
    first = df.where(v.isNotNull()).select(v.alias("v"))
    d = first.agg(F.max(F.size("v"))).first()[0] or 0
    n, total, outer = 0, np.zeros(d), np.zeros((d, d))
    cells = first.select(F.posexplode("v").alias("i", "x"), "v").select("i", F.posexplode("v").alias("j", "y"), "x").where("i <= j")
    for r in cells.groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum("x").alias("sx"), F.count("*").alias("n")).collect():
        outer[r["i"], r["j"]] = outer[r["j"], r["i"]] = r["xy"]
        if r["i"] == r["j"]:
            total[r["i"]], n = r["sx"], r["n"]
    mean = total / max(n, 1)
    precision = np.linalg.inv(outer / max(n, 1) - np.outer(mean, mean) + ridge * np.eye(d)) if d else outer
    centred = F.zip_with(v, F.lit(mean.tolist()), lambda a, m: a - m)
    rows = F.lit(precision.tolist())
    inner = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    m2 = inner(F.col("__c"), F.transform(rows, lambda row: inner(row, F.col("__c"))))
    return df.withColumn("__c", centred).select(key, m2.alias("m2"))


def semivariogram(pairs: DataFrame, z1: str, z2: str, distance: str, width: float) -> DataFrame:
    """(bin, n, gamma): half the mean squared difference of values by distance class."""
    d = F.col(z1) - F.col(z2)
    return pairs.groupBy(F.floor(F.col(distance) / width).cast("long").alias("bin")).agg(F.count("*").alias("n"), (F.avg(d * d) / 2).alias("gamma"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, inverse, complement): sample weights 1 / n of the class and 1 - its share."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))  # over one row for each class
    return counts.withColumn("t", total).select("label", "n", (1 / F.col("n")).alias("inverse"), (1 - F.col("n") / F.col("t")).alias("complement"))


def islands(df: DataFrame, key: str, order: list[str], x: str, y: str, gap: float) -> DataFrame:
    """Line fits over runs of rows whose values step by less than ``gap``: (key, island, n, slope, intercept)."""
    w = Window.partitionBy(key).orderBy(*order)
    broken = F.when(F.abs(F.col(y) - F.lag(y).over(w)) < gap, 0).otherwise(1)
    marked = df.withColumn("__new", broken).withColumn("island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "island").agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def macro_scores(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row: precision, recall and F1, each averaged over classes; a class never predicted has precision 0."""
    per = per_class_scores(df, label, prediction)
    zero = F.lit(0.0)
    return per.agg(F.avg(F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), zero)).alias("precision"), F.avg(F.coalesce("recall", zero)).alias("recall"), F.avg("f1").alias("f1"))


def pixel_accuracy(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row: the share of rows predicted rightly and the mean of the classes' shares of overlap; labels below 0 are ignored."""
    valid = df.where(F.col(label) >= 0)
    return valid.agg(F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("accuracy")).crossJoin(iou_by_class(valid, label, prediction).agg(F.avg("iou").alias("mean_iou")))


def running_mean(df: DataFrame, key: str, order: list[str], value: str, weight: str) -> DataFrame:
    """``df`` with ``mean``: of all rows of the key so far, weighted."""
    so_far = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("mean", F.sum(F.col(value) * F.col(weight)).over(so_far) / F.nullif(F.sum(weight).over(so_far), F.lit(0)))


def top_k_accuracy(scores: DataFrame, truths: DataFrame, ks: tuple[int, ...] = (1, 5)) -> DataFrame:
    """One row: for each k the share of queries whose true class (query_id, truth) is among the k best of (query_id, label,
    score), ties to the smaller label; a query without scores is wrong."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "label"))
    ranked = scores.withColumn("__r", rank).select("query_id", F.col("label").alias("truth"), "__r")
    met = truths.join(ranked, ["query_id", "truth"], "left")
    return met.agg(*(F.avg(F.coalesce(F.col("__r") <= k, F.lit(False)).cast("double")).alias(f"top_{k}") for k in ks))
