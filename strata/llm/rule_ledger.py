"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements
and one ``fail_bits`` long with a bit per failed rule. A policy is a named,
versioned mask over those bits: applying it is a bitwise AND, so policies can
be changed and compared without reading a text again. ``ablations`` tells, for
each rule of a policy, how many documents fail it, fail only it, and how many
the policy would keep without it, in one aggregation over the bits.

Built-in functions only: whole texts stay in the JVM. Null text counts as
empty: all measurements 0, and the word rules fail. An empty table gives an
empty ledger; repeated rows are judged each by itself; columns of the input
that carry names of the ledger are left out unless they are the id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: Rules in bit order: name -> condition under which a document fails.
#: The first two are the base rules, the others the method's own.
RULES: dict[str, Callable[[], Column]] = {
    "few_words": lambda: F.col("n_words") < 10,
    "repeated_windows": lambda: 100 * F.col("n_repeat_words") > 20 * F.col("n_words"),
    "repeated_lines": lambda: 100 * F.col("n_dup_lines") > 30 * F.col("n_lines"),
    "symbols": lambda: 10 * F.col("n_symbols") > F.col("n_words"),
    "word_length": lambda: (F.col("word_chars") < 2 * F.col("n_words"))
    | (F.col("word_chars") > 20 * F.col("n_words")),
}
BIT = {name: i for i, name in enumerate(RULES)}

#: Versioned policies: the rules each of them applies.
POLICIES = {
    "base-1": ("few_words", "repeated_windows"),
    "full-1": tuple(RULES),
}

WINDOW = 5


def mask(rules) -> int:
    return sum(1 << BIT[r] for r in rules)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` bound to a lambda variable: evaluated once,
    however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows of ``window`` words that occur twice or more."""

    def covered(starts: Column) -> Column:
        # starts ascend; each adds what the one before has not covered
        step = F.aggregate(
            starts, F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last")),
            lambda acc, s: F.struct(
                (acc["n"] + F.least(F.lit(window), s - acc["last"])).alias("n"), s.alias("last")))
        return step["n"]

    def repeated(hashes: Column) -> Column:
        def pairs(tagged: Column) -> Column:
            # neighbours in hash order: a member of a pair of equals is repeated
            n = F.size(tagged)
            after = F.zip_with(F.slice(tagged, F.lit(1), n - 1), F.slice(tagged, F.lit(2), n - 1),
                               lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
            return F.array_sort(F.array_distinct(F.flatten(F.array_compact(after))))
        tagged = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)) \
            .otherwise(covered(let(tagged, pairs)))

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - window),
                           lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(window))))

    return F.when(F.size(words) < window + 1, F.lit(0)) \
        .otherwise(let(words, lambda w: let(windows(w), repeated))).cast("long")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: measurements and failure bits."""
    text = F.col("_text")
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("_text"))
    rows = rows.select("doc_id", "_text", words.alias("_words"), lines.alias("_lines"))
    measured = rows.select(
        "doc_id",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("_words")).alias("n_repeat_words"))
    bits = F.lit(0).cast("long")
    for name, failed in RULES.items():
        bits = bits.bitwiseOR(F.when(failed(), F.lit(1 << BIT[name]).cast("long")).otherwise(F.lit(0).cast("long")))
    return measured.withColumn("fail_bits", bits)


def apply_policy(led: DataFrame, policy: str) -> DataFrame:
    """``kept``: no rule of the policy failed."""
    m = mask(POLICIES[policy])
    return led.withColumns({"kept": F.col("fail_bits").bitwiseAND(F.lit(m).cast("long")) == 0,
                            "policy": F.lit(policy)})


def ablations(led: DataFrame, policy: str) -> DataFrame:
    """Per rule of the policy: documents that fail it, that fail it alone, and
    that the policy without it keeps. One pass of bitwise aggregates."""
    rules = POLICIES[policy]
    hit = F.col("fail_bits").bitwiseAND(F.lit(mask(rules)).cast("long"))
    kept = F.count_if(hit == 0)
    one = led.agg(F.array(*(F.struct(
        F.lit(r).alias("rule"),
        F.count_if(F.bit_get(F.col("fail_bits"), F.lit(BIT[r])) == 1).alias("n_failed"),
        F.count_if(hit == (1 << BIT[r])).alias("n_failed_alone"),
        (kept + F.count_if(hit == (1 << BIT[r]))).alias("n_kept_without")) for r in rules)).alias("r"),
        F.coalesce(F.bit_or("fail_bits"), F.lit(0)).alias("bits_seen"))
    return one.select(F.explode("r").alias("r"), "bits_seen").select("r.*", "bits_seen")
