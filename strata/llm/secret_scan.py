r"""Secret scan: pattern spans plus sliding-window entropy spans.

Base kinds (leftmost, not overlapping within a kind; a match that fails its
length test is dropped but has consumed its characters):

* ``assign`` - a secret-like key, ``:`` or ``=``, and a value of 6 or more;
* ``access`` - ``AKIA`` and capitals or digits, 20 or more in all;
* ``hex`` - 24 or more lower-case hexadecimal digits.

The method's kinds come from candidate strings (long runs of key characters).
Within a candidate, every maximal run of one character class is scanned with a
window: symbol counts are kept in an array and updated by one symbol in and
one out per step, and with them S = sum(c * log2 c), so the window's Shannon
entropy is log2(W) - S / W. A run whose window reaches the class's threshold
gives a span from the first to the last such window. Candidates on the
allow-list (UUIDs, plain words or paths, repeated placeholders) are suppressed.
Placeholder words inside a candidate suppress the windows over them only: a key
beside them is still found. Base spans are never suppressed.

Only built-in functions. Positions are code points, end exclusive. They come
from the lengths of matches and of the pieces between them, summed in blocks
(``spans``), so a text with very many matches costs little more than its length. Null text counts as empty (no spans); an empty table gives
no rows; repeated rows are scanned each by itself; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty
from .spans import let, located, redacted

#: The base patterns. A run of at least n characters is the same
#: as a run that is dropped below n, as runs are maximal.
ASSIGN = (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6
#: Kinds in the order in which equal starts are listed.
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64", "entropy_url", "entropy_short")

#: Candidate strings for the entropy windows.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Character classes: kind -> (class, its symbols, window, least entropy).
CLASSES = {
    "entropy_hex": ("[0-9A-Fa-f]", "0123456789abcdefABCDEF", 20, 3.0),
    "entropy_base64": ("[A-Za-z0-9+/]", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 24, 3.9),
    # keys of the URL-safe alphabet, hyphenated and prefixed tokens, letters and digits from 20 on
    "entropy_url": ("[A-Za-z0-9_-]", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-", 20, 3.8),
    # base64 runs shorter than the window of entropy_base64
    "entropy_short": ("[A-Za-z0-9+/]", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 20, 3.8),
}
#: Candidates that are no secrets: no digit at all, UUIDs, words or paths with
#: a number at the end, one or two characters over and over, running alphabets.
ALLOWED = (r"^[^0-9]*$", r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
           r"^([A-Za-z]+[-_/])*[A-Za-z]+[-_/]?[0-9]{1,4}$", r"^(.{1,2})\1+.?$")
#: Words in any case over which there is no window: each is blanked before the runs are taken.
PLACEHOLDERS = ("example", "placeholder", "0123456789", "abcdefghij")


def plogp(n: Column) -> Column:
    return F.when(n < 2, F.lit(0.0)).otherwise(n * F.log2(n.cast("double")))


def window_hull(run: Column, symbols: str, width: int, least: float) -> Column:
    """struct<lo, hi>: begin of the first and end of the last window of ``run``
    whose entropy is at least ``least`` (lo null when there is none). Counts
    and S are updated by the symbol that enters and the one that leaves."""
    codes = F.transform(F.split(run, ""), lambda c: F.instr(F.lit(symbols), c) - 1)

    def walk(entering: Column) -> Column:
        steps = F.zip_with(entering, F.slice(F.concat(F.array_repeat(F.lit(-1), width), entering),
                                             F.lit(1), F.size(entering)),
                           lambda x, y: F.struct(x.alias("x"), y.alias("y")))
        start = F.struct(F.array_repeat(F.lit(0), len(symbols)).alias("n"), F.lit(0.0).alias("s"), F.lit(0).alias("i"),
                         F.lit(None).cast("int").alias("lo"), F.lit(None).cast("int").alias("hi"))

        def count(acc, code):
            return F.when(code < 0, F.lit(0)).otherwise(F.get(acc["n"], code))

        def update(acc, p):
            out, into = count(acc, p["y"]), count(acc, p["x"])
            into_left = into - F.when(p["x"] == p["y"], F.lit(1)).otherwise(F.lit(0))
            s = (acc["s"] + plogp(out - 1) - plogp(out) + plogp(into_left + 1) - plogp(into_left))
            i = acc["i"] + 1
            hit = (i >= width) & (F.lit(math.log2(width)) - s / width >= least - 1e-9)
            n = F.transform(acc["n"], lambda v, k: v + F.when(k == p["x"], 1).otherwise(0)
                            - F.when(k == p["y"], 1).otherwise(0))
            return F.struct(n.alias("n"), s.alias("s"), i.alias("i"),
                            F.when(hit, F.coalesce(acc["lo"], i - width)).otherwise(acc["lo"]).alias("lo"),
                            F.when(hit, i).otherwise(acc["hi"]).alias("hi"))

        return F.aggregate(steps, start, update, lambda acc: F.struct(acc["lo"].alias("lo"), acc["hi"].alias("hi")))

    return F.element_at(F.transform(F.array(codes), walk), 1)


def entropy_spans(candidates: Column, kind: str) -> Column:
    """Spans of one character class in located candidates."""
    chars, symbols, width, least = CLASSES[kind]

    def of_candidate(c: Column) -> Column:
        text = c["m"]
        for word in PLACEHOLDERS:
            text = F.regexp_replace(text, f"(?i){word}", " " * len(word))
        runs = located(text, f"{chars}{{{width},}}")
        hulls = F.transform(runs, lambda r: F.struct(
            (c["a"] + r["a"]).alias("at"), window_hull(r["m"], symbols, width, least).alias("h")))
        return F.transform(F.filter(hulls, lambda h: h["h"]["lo"].isNotNull()), lambda h: span(
            kind, h["at"] + h["h"]["lo"], h["at"] + h["h"]["hi"]))

    return F.flatten(F.transform(candidates, of_candidate))


def span(kind: str, a: Column, b: Column) -> Column:
    return F.struct(a.alias("a"), F.lit(KINDS.index(kind)).alias("k"), b.alias("b"))


def as_spans(found: Column, kind: str) -> Column:
    return F.transform(found, lambda m: span(kind, m["a"], m["b"]))


def listed(spans: Column) -> Column:
    """kind:start:end, by start, then kind as listed, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.get(names, s["k"]), s["a"].cast("string"), s["b"].cast("string"))), ",")


def with_spans(docs: DataFrame, text: str, base: str, added: str) -> DataFrame:
    """``docs`` with two array columns: base spans and the method's spans."""
    t = F.col(text)
    long_enough = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= ASSIGN_LEAST
    allowed = lambda m: F.lit(False) if not ALLOWED else _any(m.rlike(p) for p in ALLOWED)
    found = F.concat(as_spans(located(t, ASSIGN, long_enough), "assign"),
                     as_spans(located(t, ACCESS), "access"), as_spans(located(t, HEX), "hex"))
    candidates = F.filter(located(t, CANDIDATE), lambda c: ~allowed(c["m"]))
    more = F.element_at(F.transform(F.array(candidates), lambda cs: F.concat(
        *(entropy_spans(cs, kind) for kind in CLASSES))), 1)
    return docs.withColumns({base: found, added: more})


def _any(tests) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts of the base kinds and all spans."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    rows = with_spans(rows, "text", "base", "added").select("doc_id", "base", "added")
    count = lambda kind: F.size(F.filter(
        F.col("base"), lambda s: s["k"] == KINDS.index(kind))).cast("long")
    return rows.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.size("added").cast("long").alias("n_entropy"), F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.concat("base", "added")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[secret]", text_col: str = "text") -> DataFrame:
    """``docs`` with every span's characters replaced by ``mark`` (overlapping
    spans as one); all other columns stay as they are, null text stays null."""
    taken = {c.lower() for c in docs.columns}
    names = []
    for name in ("scan_text", "scan_base", "scan_added"):
        while name in taken:
            name += "_"
        names.append(name)
    t, base, added = names
    rows = with_spans(docs.withColumn(t, text_or_empty(text_col)), t, base, added)

    spans = F.array_sort(F.concat(F.col(base), F.col(added)))
    text = F.when(F.col(text_col).isNotNull(), let(spans, lambda s: redacted(F.col(t), s, mark)))
    return rows.withColumn(text_col, text).select(*docs.columns)
