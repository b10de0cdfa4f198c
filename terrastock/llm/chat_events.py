"""Chat conversations rebuilt from event logs, rendered and read back (operator 8).

``fold_events`` partitions a log by conversation, sorts it by sequence and folds streamed deltas, edits and
regenerations into final messages; ``render_turns`` writes each message with its markers; ``read_back`` parses the
rendered text again and digests it.

One shuffle by conversation serves all three. Folding sorts a conversation's events in windows, which spill, and
gathers the pieces of one message at a time; rendering and reading back stream the turns. So memory goes with the
longest message.

Defined results: a null text or role counts as empty; rows that tie in order are taken by role and then by text;
repeated rows are turns of their own; a null conversation is one conversation; an empty log gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
_ANY = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
TURNS = "conv_id long, turn long, role string, text string, formatted string, loss_start int, loss_end int"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str) -> str:
    """``text`` in which no control string can occur: a backslash is put into each ``<|``, and one more where some are."""
    return _ANY.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def fold_events(log: DataFrame, conv: str = "conv_id", seq: str = "seq", kind: str = "kind", message: str = "message", role: str = "role", text: str = "text") -> DataFrame:
    """Final messages (conv_id, turn, role, text) of a log of events.

    A ``message``, ``edit`` or ``regenerate`` event sets the text of its message, and a ``delta`` adds to it. An edit
    or a regeneration also takes away the messages after it that were begun earlier, as they answered what is gone.
    """
    of_conv, of_message = Window.partitionBy("conv_id"), Window.partitionBy("conv_id", "message")
    sets = F.col("kind") != "delta"
    events = log.select(
        F.col(conv).cast("long").alias("conv_id"), F.col(seq).cast("long").alias("seq"), F.coalesce(kind, F.lit("message")).alias("kind"),
        F.col(message).cast("long").alias("message"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"),
    )
    live = events.withColumns(
        {
            "since": F.max(F.when(sets, F.col("seq"))).over(of_message),
            "begun": F.min("seq").over(of_message),
            "cut": F.max(F.when(F.col("kind").isin("edit", "regenerate"), F.col("seq"))).over(of_message),
        }
    ).where(F.col("since").isNull() | (F.col("seq") >= F.col("since")))
    messages = live.groupBy("conv_id", "message").agg(
        F.first("begun").alias("begun"), F.first("cut").alias("cut"), F.min_by("role", F.struct("seq", "role", "text")).alias("role"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "role", "text"))), lambda e: e["text"]), "").alias("text"),
    )
    latest = F.max("cut").over(of_conv.orderBy("message").rowsBetween(Window.unboundedPreceding, -1))
    return messages.withColumn("__cut", latest).where(F.col("__cut").isNull() | (F.col("begun") > F.col("__cut"))).select("conv_id", F.col("message").alias("turn"), "role", "text")


def events_of_turns(turns: DataFrame) -> DataFrame:
    """A log of events (conv_id, seq, kind, message, role, text) that folds to given turns (conv_id, place, role, text), as
    a chat's server would have kept it: by a hash, a turn came whole, streamed, edited or regenerated.

    An edited or regenerated turn first had another text, and was followed by an answer that the change takes away.
    """
    text = F.coalesce("text", F.lit(""))
    third = F.floor(F.char_length(text) / 3).cast("int")
    cuts = [F.substr(text, F.lit(1), third), F.substr(text, third + 1, third), F.substr(text, 2 * third + 1, F.char_length(text))]
    event = lambda step, kind, own, role=F.col("role"), later=0: F.struct((F.col("place") * 16 + step).alias("seq"), F.lit(kind).alias("kind"), (F.col("place") * 2 + later).alias("message"), role.alias("role"), own.alias("text"))
    streamed = [event(8 + k, "delta", c) for k, c in enumerate(cuts)]
    gone = [event(0, "message", F.concat(F.lit("superseded "), cuts[0])), event(1, "delta", F.lit(" and more")), event(2, "message", F.lit("an answer to what is gone"), F.lit("assistant"), 1)]
    how = F.pmod(F.xxhash64("conv_id", "place", text), F.lit(4))
    log = (
        F.when(how == 0, F.array(event(0, "message", text)))
        .when(how == 1, F.array(event(0, "message", F.lit("")), *streamed))
        .when(how == 2, F.array(*gone, event(7, "edit", cuts[0]), *streamed[1:]))
        .otherwise(F.array(*gone, event(7, "regenerate", F.lit("")), *streamed))
    )
    return turns.select("conv_id", F.explode(log).alias("e")).select("conv_id", "e.*")


def ordered(messages: DataFrame) -> DataFrame:
    """Messages with each conversation in one partition and in order."""
    return messages.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def render_turns(messages: DataFrame) -> DataFrame:
    """Each message of ``ordered`` ones with its formatted text and where the loss lies in it, in code points.

    Texts of assistants are under the loss mask, markers are not. A conversation's text is that of its turns in order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            formatted, start, end = [], [], []
            for role, text in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                head, body = f"{OPEN}{escape_role(role or '')}\n", escape(text or "")
                formatted.append(f"{head}{body}{CLOSE}\n")
                start.append(len(head))
                end.append(len(head) + (len(body) if role == "assistant" else 0))
            made = [pa.array(formatted, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32())]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], names=[x.split()[0] for x in TURNS.split(", ")])

    return messages.select("conv_id", "turn", "role", "text").mapInArrow(run, TURNS)


class _Reading:
    """What is read back of one conversation so far."""

    def __init__(self, conv: int | None) -> None:
        self.conv, self.turns, self.chars, self.loss = conv, 0, 0, 0
        self.all, self.learned = hashlib.sha256(), hashlib.sha256()

    def take(self, formatted: str, start: int, end: int) -> None:
        m = re.fullmatch(rf"{re.escape(OPEN)}([^\n]*)\n(.*){re.escape(CLOSE)}\n", formatted, re.DOTALL)
        if not m or OPEN in m[2] or CLOSE in m[2]:
            raise ValueError(f"conversation {self.conv}: a turn can't be read back")
        self.turns += 1
        self.chars += len(formatted)
        self.all.update(f"{unescape_role(m[1])}\n{unescape(m[2])}\n".encode())
        masked = unescape(formatted[start:end])
        self.loss += len(masked)
        self.learned.update(masked.encode())

    def row(self) -> tuple:
        return self.conv, self.turns, self.all.hexdigest(), self.loss, self.learned.hexdigest(), self.chars


def read_back(rendered: DataFrame) -> DataFrame:
    """Parse rendered turns, which must come in order, and digest each conversation."""
    names = [x.split()[0] for x in DIGESTS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def rows(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate(types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for b in batches:
            done = []
            for conv, formatted, start, end in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if now is None or now.conv != conv:
                    if now:
                        done.append(now.row())
                    now = _Reading(conv)
                now.take(formatted, start, end)
            if done:
                yield rows(done)
        if now:
            yield rows([now.row()])

    return rendered.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(run, DIGESTS)
