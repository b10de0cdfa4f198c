"""Plain versions of the text operators, and the odd rows that every operator must bear."""

import hashlib
import re

BLANK = " \t\n\x0b\x0c\r"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = "one two three four five six seven. " * 3000
#: doc_id, text: nulls, empty, blank and very long texts, repeated rows, ties.
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, LONG), (6, LONG), (7, "12345 67890!"), (8, "Zwölf Boxkämpfer\njagen　ﬁne\r\n日本語 😀"), (8, "a b c d e f"), (8, "a b c d e f"), (None, "no id at all here"), (9, "x" * 5000)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def odd(spark, rows=ODD):
    return spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def shingles(text, words=5):
    found = [w for w in re.split(f"[{BLANK}]+", (text or "").translate(UPPER)) if w]
    if not found:
        return frozenset()
    return frozenset(tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1)))


def components(docs):
    """(size of the set, least doc_id reachable by links) of each (doc_id, text)."""
    sets = {k: shingles(t) for k, t in docs}
    least = {k: k for k in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while True:
        moved = False
        for a, b in links:
            m = min(least[a], least[b])
            if (least[a], least[b]) != (m, m):
                least[a] = least[b] = m
                moved = True
        if not moved:
            return {k: (len(s), least[k]) for k, s in sets.items()}


def kept_lines(docs):
    """(n_lines, n_dropped, text) of each (doc_id, text) with distinct ids."""
    key = lambda line: line.strip(BLANK).translate(UPPER)
    holders = {}
    for k, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                holders.setdefault(key(line), set()).add(k)
    out = {}
    for k, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(h := holders.get(key(x), ())) >= 5 and k != max(h))]
        out[k] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    """Base spans as (start, place of the kind, end)."""
    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(digits(s)) <= 19 and luhn(digits(s))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    ]
    return sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(kinds) for m in re.finditer(p, text or "") if ok(m[0]))
