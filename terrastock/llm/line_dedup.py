"""Removal of lines that recur over many documents (operator 6, DataFrame functions only).

Lines are exploded and normalised, their keys hashed to 128 bits, and distinct documents counted for each key. Lines
whose key is long enough and found in enough documents go, except in the largest document that holds the key; the
other lines are put together again by position.

Plan: texts are exploded once, to a table of (id, position, hash) rows of long lines in the shared folder. The counts
are aggregated before they are shuffled, so a line of every document costs a row for each task. The recurring keys are
a table of their own, so that the rows of a hot key meet it in a join whose skewed partitions Spark splits. Texts move
once, to meet their dropped positions, or stay where they are if those are few enough to be sent to every task.

Defined results: a null or empty text is one empty line and is never changed from null by a drop, since an empty line
is short; ids may repeat, and equal ids count as one document; null ids count as one document below all others;
extra columns pass through; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrastock.llm.common import cut

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LONG = -(2**63)


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z lower-cased; other letters keep their case."""
    stripped = F.btrim(line, F.lit(BLANKS))
    plain = F.octet_length(stripped) == F.char_length(stripped)
    return F.when(plain, F.lower(stripped)).otherwise(F.translate(stripped, UPPER, LOWER))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def drop_recurring_lines(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 40, min_docs: int = 5, n_lines: str = "n_lines", n_dropped: str = "n_dropped"
) -> DataFrame:
    """``docs`` with ``text`` less its recurring lines, and the columns ``n_lines`` (before) and ``n_dropped``."""
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))  # names of the input can't clash
    whole = F.col("row").getField(text)
    key_id = F.coalesce(F.col("row").getField(doc_id).cast("long"), F.lit(LEAST_LONG)).alias("id")
    of_text = F.xxhash64(F.coalesce(whole, F.lit(""))).alias("of_text")  # tells rows of one id apart
    marks = cut(
        row.select(key_id, of_text, F.posexplode(lines_of(whole)).alias("pos", "line"))
        .where(F.char_length("line") >= min_chars)
        .select("id", "of_text", "pos", line_key(F.col("line")).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("id", "of_text", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))
    )
    recurring = cut(
        marks.groupBy("h1", "h2")
        .agg(F.count_distinct("id").alias("held"), F.max("id").alias("keeper"))
        .where(F.col("held") >= min_docs)
        .select("h1", "h2", "keeper")
    )
    drops = marks.join(recurring, ["h1", "h2"]).where("id <> keeper").groupBy("id", "of_text").agg(F.collect_set("pos").alias("drop"))
    lines = lines_of(whole)
    kept = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains(F.col("drop"), i)), "\n")
    rest = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in (text, n_lines, n_dropped)]
    return (
        row.withColumns({"id": key_id, "of_text": of_text})
        .join(drops, ["id", "of_text"], "left")
        .select(
            F.struct(
                *rest,
                F.when(F.col("drop").isNull(), whole).otherwise(kept).alias(text),
                F.size(lines).cast("long").alias(n_lines),
                F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias(n_dropped),
            ).alias("out")
        )
        .select("out.*")
    )
