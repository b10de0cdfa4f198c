"""A training-corpus pipeline over ``documents``: quality, recurring lines, near duplicates, personal data, packing.

``STAGES`` are applied in order; each works on all that the stage before kept, and is written as Parquet in the shared
folder and read again. All but the last return the columns of documents; further columns of the input are left out.

Defined results: a null text counts as empty, is scored, kept and packed like an empty one, and stays null until it is
packed; rows without words are no copies of each other. Rows with a null id take part in every stage; of a group of near
duplicates the row with the smallest id stays, nulls last, and of rows alike in all columns one. An empty table gives
no pieces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrastock.llm import line_dedup, mil_quality, parity_join, pii, window_packing
from terrastock.llm.common import cut, shared_folder
from terrastock.llm.queries import learnable_labels, tokenizer_file

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, with ``n_chars`` of the text as it is now."""
    return df.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it learns from labels of documents not held out."""
    model = mil_quality.train_quality(docs, learnable_labels(spark, sf_dir))
    return _documents(mil_quality.score_quality(docs.select(*COLUMNS), model, score="__score").where("__score >= 0.5"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that recur over documents; a document may be left with an empty text."""
    return _documents(line_dedup.drop_recurring_lines(docs.select(*COLUMNS)))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, the smallest by id with nulls last, of each group of near duplicates; rows without words all stay."""
    met = parity_join.near_duplicates(docs).where(F.col("node").isNotNull()).groupBy("mark").agg(F.first("first").alias("first"), F.count("*").alias("n"))
    extra = cut(met.where("mark <> first or n > 1").select(F.col("mark").alias("__mark"), (F.col("mark") == F.col("first")).alias("__repeated")))
    marked = docs.select(*COLUMNS, parity_join.mark().alias("__mark"))
    kept = marked.join(extra.select("__mark"), "__mark", "left_anti").select(*COLUMNS)
    repeated = extra.where("__repeated")
    if not repeated.isEmpty():  # of rows that are the first alike, by id and text, one
        same = marked.join(repeated, "__mark", "left_semi").groupBy("__mark").agg(F.min(F.struct(*COLUMNS)).alias("__row"))
        kept = kept.unionByName(same.select("__row.*"))
    return _documents(kept)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with each span of personal data replaced by its kind."""
    return _documents(pii.redact(pii.find_personal_data(docs.select(*COLUMNS), spans="__spans"), spans="__spans"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens."""
    import public_tokenizers

    return window_packing.pack_documents(docs, tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", keep_one_of_each),
    ("PII", redact_personal_data),
    ("packing", pack),
]

#: The classifier and the tokenizer can't be expressed in SQL; the tests check the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed corpus of ``documents`` in ``sf_dir``."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
