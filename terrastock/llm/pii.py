"""Personal data in texts (operator 7, DataFrame functions only).

Regular expressions propose spans, checks confirm them (digit counts, address parts, Luhn, mod 97) and words nearby
raise their score. The four base kinds are kept whenever their check holds; the added kinds (``iban``, ``ssn``) are
kept from a score of ``LEAST_SCORE`` on.

Positions come from the gaps between matches: splitting by a pattern gives the texts between the matches that
extracting by the same pattern gives, so both lengths add up to offsets. Possessive repeats and look-behinds keep the
matching linear and without recursion on long texts; they match exactly what the plain patterns match, as each is
followed by a character that the repeat before it can't take. All is row by row: nothing is shuffled.

Defined results: a null text counts as empty; offsets are code points, ends exclusive; repeated rows are searched
alike; extra columns pass through; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: In the order in which spans that start together are listed.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]
LEAST_SCORE = 0.5
CONTEXT_CHARS = 40

_LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: A text without this has no span of the kind.
NEEDS = {"email": "@", "phone": "+"}
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.7, "ssn": 0.3}
WORDS = {
    "email": r"(?i)\b(?:e-?mail|contact|write to|reach)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|login)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|credit|payment|cvv)\b",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|fax)\b",
    "iban": r"(?i)\b(?:iban|account|bank|transfer)\b",
    "ssn": r"(?i)\b(?:ssn|social security)\b",
}
CONTEXT_GAIN = {"email": 0.1, "ip": 0.2, "card": 0.2, "phone": 0.3, "iban": 0.2, "ssn": 0.4}


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(s: Column) -> Column:
    """Of digits only: every second digit from the right is doubled, and all digits add up to a multiple of ten."""
    doubled = F.transform(
        F.split(F.reverse(s), ""),
        lambda d, i: F.when(i % 2 == 0, d.try_cast("int")).otherwise(F.coalesce(d.try_cast("int") * 2 - F.when(d >= "5", 9).otherwise(0), F.lit(0))),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def _mod97(s: Column) -> Column:
    """Of an account number without blanks: its first four signs moved to the end, letters read as 10 to 35."""
    moved = F.concat(F.substr(s, F.lit(5)), F.substr(s, F.lit(1), F.lit(4)))
    step = lambda a, c: F.when(c == "", a).when(c <= "9", (a * 10 + c.try_cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(moved, ""), F.lit(0), step) == 1


def _holds(kind: str, s: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(s, r"\."), lambda p: (F.char_length(part(p)) <= 3) & (part(p).try_cast("int") <= 255))
    if kind == "card":
        return F.char_length(_digits(s)).between(12, 19) & _luhn(_digits(s))
    if kind == "phone":
        return F.char_length(_digits(s)).between(9, 15)
    if kind == "iban":
        return _mod97(F.replace(s, F.lit(" "), F.lit("")))
    return F.lit(True)


def _found(kind: str, text: Column) -> Column:
    """Spans of a kind in ``text``: array of (start, kind's place, end, score)."""
    pattern, place = F.lit(PATTERNS[kind]), KINDS.index(kind)
    pairs = F.zip_with(F.split(text, PATTERNS[kind], -1), F.regexp_extract_all(text, pattern, F.lit(0)), lambda g, m: F.struct(F.char_length(g).alias("gap"), m.alias("match")))
    at = F.aggregate(
        F.filter(pairs, lambda p: p["match"].isNotNull()),
        F.struct(F.lit(0).alias("to"), F.expr("cast(array() as array<struct<start:int,match:string>>)").alias("all")),
        lambda a, p: F.struct(
            (a["to"] + p["gap"] + F.char_length(p["match"])).alias("to"),
            F.array_append(a["all"], F.struct((a["to"] + p["gap"]).alias("start"), p["match"].alias("match"))).alias("all"),
        ),
    )["all"]
    checked = F.filter(at, lambda x: _holds(kind, x["match"]))

    def scored(x: Column) -> Column:
        end = x["start"] + F.char_length(x["match"])
        since = F.greatest(x["start"] - CONTEXT_CHARS, F.lit(0))
        near = F.concat(F.substr(text, since + 1, x["start"] - since), F.lit(" "), F.substr(text, end + 1, F.lit(CONTEXT_CHARS)))
        score = F.lit(PRIOR[kind]) + F.when(near.rlike(WORDS[kind]), CONTEXT_GAIN[kind]).otherwise(0.0)
        return F.struct(x["start"].alias("start"), F.lit(place).alias("place"), end.alias("end"), score.alias("score"))

    kept = F.transform(checked, scored)
    if kind not in BASE:
        kept = F.filter(kept, lambda x: x["score"] >= LEAST_SCORE)
    may = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else text.rlike("[0-9][0-9.\\x20-]*[0-9]")
    return F.when(may, kept).otherwise(F.expr("cast(array() as array<struct<start:int,place:int,end:int,score:double>>)"))


def find_personal_data(docs: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """``docs`` with ``spans``: array of (kind, start, end, score), by start and then by kind as listed."""
    whole = F.coalesce(F.col(text), F.lit(""))
    names = F.array(*(F.lit(k) for k in KINDS))
    every = F.array_sort(F.concat(*(_found(k, whole) for k in KINDS)))
    named = F.transform(every, lambda x: F.struct(F.get(names, x["place"]).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["score"].alias("score")))
    return docs.withColumn(spans, named)


def redact(found: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """``found`` with each span of ``text`` replaced by its kind in brackets; spans that overlap become one."""
    whole = F.col(text)
    start = F.struct(F.lit(0).alias("to"), F.expr("cast(array() as array<string>)").alias("parts"))

    def step(a: Column, s: Column) -> Column:
        fresh = s["start"] >= a["to"]
        cut = F.array(F.substr(whole, a["to"] + 1, s["start"] - a["to"]), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        return F.struct(F.greatest(a["to"], s["end"]).alias("to"), F.when(fresh, F.concat(a["parts"], cut)).otherwise(a["parts"]).alias("parts"))

    put = F.aggregate(F.col(spans), start, step, lambda a: F.concat(F.array_join(a["parts"], ""), F.substr(whole, a["to"] + 1)))
    return found.withColumn(text, F.when(F.size(spans) > 0, put).otherwise(whole))
