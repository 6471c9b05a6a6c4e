"""Text spans by built-in functions: where patterns match, and redaction.

Positions are code points, ends exclusive. They are running sums over arrays.
An array that a fold appends to is copied at every step, which is quadratic in
a text with very many matches; so arrays are folded in blocks of about the
square root of their size, and the blocks' offsets by one more fold.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` bound to a lambda variable: evaluated once,
    however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def blocked(values: Column, size: Column) -> Column:
    """The array cut into blocks of ``size``; must not be empty."""
    return F.transform(F.sequence(F.lit(0), F.ceil(F.size(values) / size).cast("int") - 1),
                       lambda k: F.slice(values, k * size + 1, size))


def root(values: Column) -> Column:
    return F.ceil(F.sqrt(F.size(values).cast("double"))).cast("int")


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """array<int> one longer than the array<int> ``values``: what ``combine``
    (associative, 0 is neutral) makes of all values before each place."""
    none = F.array().cast("array<int>")

    def within(block: Column) -> Column:
        return F.aggregate(block, F.struct(F.lit(0).alias("all"), none.alias("out")), lambda acc, v: F.struct(
            combine(acc["all"], v).alias("all"), F.concat(acc["out"], F.array(acc["all"])).alias("out")))

    def joined(folds: Column) -> Column:
        totals = within(F.transform(folds, lambda f: f["all"]))
        return let(totals, lambda t: F.concat(F.flatten(F.zip_with(folds, t["out"], lambda f, before: F.transform(
            f["out"], lambda v: combine(before, v)))), F.array(t["all"])))

    return let(values, lambda vs: F.when(F.size(vs) == 0, F.array(F.lit(0))).otherwise(
        let(F.transform(blocked(vs, root(vs)), within), joined)))


def located(text: Column, pattern: str, keep: Callable[[Column], Column] | None = None, context: int = 0,
            needs: str | None = None) -> Column:
    """array<struct<m, a, b>>: the matches of ``pattern`` (never empty ones) and
    their positions, less those that fail ``keep``. With ``context`` also
    ``before`` and ``after``: at most so many characters on either side, up to
    the next match. Every match holds one of ``needs``, a cheaper pattern."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sides = "" if not context else ",before:string,after:string"
    none = F.array().cast(f"array<struct<m:string,a:int,b:int{sides}>>")

    def place(matches: Column) -> Column:
        def with_gaps(gaps: Column) -> Column:  # one before each match, one after the last
            parts = F.transform(matches, lambda m, i: F.struct(
                m.alias("m"), F.length(F.get(gaps, i)).alias("gap"), F.length(m).alias("n"),
                *((F.right(F.get(gaps, i), F.lit(context)).alias("before"),
                   F.left(F.get(gaps, i + 1), F.lit(context)).alias("after")) if context else ())))
            return let(parts, with_starts)

        def with_starts(parts: Column) -> Column:
            starts = running(F.transform(parts, lambda p: p["gap"] + p["n"]), lambda x, y: x + y)
            return let(starts, lambda at: F.transform(parts, lambda p, i: F.struct(
                p["m"].alias("m"), (F.get(at, i) + p["gap"]).alias("a"), (F.get(at, i) + p["gap"] + p["n"]).alias("b"),
                *((p["before"].alias("before"), p["after"].alias("after")) if context else ()))))

        placed = let(F.split(text, pattern, -1), with_gaps)
        return F.when(F.size(matches) == 0, none).otherwise(F.filter(placed, lambda p: keep(p["m"])) if keep else placed)

    return let(found, place) if needs is None else F.when(text.rlike(needs), let(found, place)).otherwise(none)


def redacted(text: Column, spans: Column, mark: str) -> Column:
    """``text`` with the spans (structs with ``a`` and ``b``, ascending by
    ``a``) replaced by ``mark``; overlapping ones are replaced as one."""

    def rebuild(ends: Column) -> Column:  # before each span, how far the spans before it reach
        items = F.transform(spans, lambda s, i: F.struct(F.get(ends, i).alias("at"), s["a"].alias("a")))

        def piece(block: Column) -> Column:
            first = F.get(block, F.lit(0))["at"]
            last = F.greatest(first, F.element_at(block, -1)["a"])
            return let(F.substring(text, first + 1, last - first), lambda t: F.array_join(F.transform(
                block, lambda p: F.when(p["a"] >= p["at"], F.concat(
                    F.substring(t, p["at"] - first + 1, p["a"] - p["at"]), F.lit(mark))).otherwise(F.lit(""))), ""))

        whole = let(items, lambda its: F.array_join(F.transform(blocked(its, root(its)), piece), ""))
        end = F.element_at(ends, -1)
        return F.concat(whole, F.substring(text, end + 1, F.length(text) - end))

    reach = running(F.transform(spans, lambda s: s["b"]), F.greatest)
    return F.when(F.size(spans) == 0, text).otherwise(let(reach, rebuild))
