r"""Personal data: base patterns, and boosted trees over candidate spans.

Base kinds (leftmost, not overlapping within a kind; a match that fails its test
is dropped but has consumed its characters): ``email``; ``ip``, four numbers of
at most 255; ``card``, 13 to 19 digits that pass Luhn's test; ``phone``, ``+``
and 9 to 15 digits.

The method adds spans of the same four sorts that the patterns or their tests
miss. Generators with a high recall propose candidates, which may overlap. A
candidate is described by small integers: format (digits, groups, separators,
letters) and context (neighbouring characters, words before it). What the base
tests decide by (Luhn, the bound of 255, the plus sign, the dots of a domain) is
withheld, so that the trees can't repeat them. Boosted trees learn, on all texts
of the corpus itself, which candidates hold a base span; a generator's threshold
is the least score from which, on texts the trees have not seen, at least
``PRECISION`` of the candidates do. Candidates above it without a base span
are the added spans. A number that looks like a card but fails Luhn's test is
left alone where such numbers are as frequent as cards.

Training is an aggregation per tree level over the corpus' distinct feature
rows, counted by texts in one pass: gradients are summed by (node, feature, value), and only these sums, a
number fixed by the parameters, reach the driver. They are whole numbers, so the
trees are the same whatever the partitioning. The trees are then an expression.

Built-in functions only; whole texts stay in the JVM, nothing is shuffled but the
candidates' features. Positions are code points, end exclusive. Null text counts as
empty (no spans); an empty table gives no rows; without base spans in the corpus
nothing is added; repeated rows are scanned each by itself (and learned from
once); rows without id are scanned like others; other columns are ignored, or
pass through ``redact`` untouched.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.materialize import materialize
from .common import text_or_empty
from .spans import let, located, redacted

#: The base patterns. Matches begin where a run of their first
#: class begins or the match before has ended, as leftmost ones do; with
#: possessive runs a text is read once, however long its runs are.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+"
CARD = r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
VALID_IP = rf"^{PART}(?:\.{PART}){{3}}$"
#: Kinds in the order in which spans are listed.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, *(f"near_{k}" for k in BASE))

#: What every match of a kind's pattern, and of its generator, holds: texts
#: without it are not searched further.
NEEDS = {
    "email": (r"@", r"@|[\[({](?:at|AT)[\])}]"),
    "ip": (r"[0-9]\.[0-9]++\.[0-9]", r"[0-9]\x20?[.,:_-]\x20?[0-9]++\x20?[.,:_-]\x20?[0-9]"),
    "card": (r"(?:[0-9][\x20-]?){12}[0-9]", r"(?:[0-9][\x20._/-]{0,2}){8}[0-9]"),
    "phone": (r"\+[0-9]", r"[0-9][0-9()\x20./-]{6}"),
}

#: Candidate generators, one per base kind.
GENERATORS = {
    "email": r"(?<![^\s@<>\"'(),;:=])[^\s@<>\"'(),;:=]++(?:\x20?[\[({](?:at|AT)[\])}]\x20?|@)[^\s@<>\"'(),;:=]++",
    "ip": r"(?<![0-9])[0-9]++(?:\x20?[.,:_-]\x20?[0-9]++){3}+",
    "card": r"(?<![0-9])[0-9](?:[\x20._/-]{0,2}[0-9]){8,}+",
    "phone": r"(?<![0-9(+])(?:\+|00|\()?[0-9][0-9()\x20./-]{6,}[0-9]",
}
#: Characters of context on either side of a candidate.
CONTEXT = 32
CUES = r"(?i)\b(?:e-?mail|mail|tel|phone|call|fax|mobile|contact|card|visa|credit|ip|host|server|address)\b"
DECOYS = r"(?i)\b(?:version|order|invoice|ref|isbn|sku|id|no|nr|number|token|hash|key|build|page)\b"
#: Values of a feature: 0 to LEVELS - 1.
LEVELS = 16

TREES, DEPTH, RATE = 8, 3, 0.5
#: Share of the candidates that must hold a base span above a threshold, and the
#: least number of candidates that a threshold is set by.
PRECISION, SUPPORT = 0.95, 20
#: Every FOLDS-th text sets the thresholds and is not learned from.
FOLDS = 4
#: Gradients are whole multiples of 1 / UNIT; RIDGE is added to second derivatives.
UNIT, RIDGE = 1 << 20, 1.0
SCORES = 50


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's test."""
    total = F.aggregate(
        F.transform(F.split(F.reverse(number), ""), lambda c, i: let(
            c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1), lambda v: F.when(v > 9, v - 9).otherwise(v))),
        F.lit(0), lambda a, v: a + v)
    return total % 10 == 0


def is_card(m: Column) -> Column:
    return let(digits(m), lambda d: F.when(F.length(d).between(13, 19), luhn(d)).otherwise(F.lit(False)))


#: kind -> (pattern, test of a match).
RULES: dict[str, tuple[str, Callable[[Column], Column] | None]] = {
    "email": (EMAIL, None),
    "ip": (IP, lambda m: m.rlike(VALID_IP)),
    "card": (CARD, is_card),
    "phone": (PHONE, lambda m: F.length(digits(m)).between(9, 15)),
}


def base_spans(text: Column) -> Column:
    """array<struct<k, a, b>> of the base kinds."""
    def of(kind: str) -> Column:
        return F.transform(located(text, *RULES[kind], needs=NEEDS[kind][0]), lambda s: F.struct(
            F.lit(KINDS.index(kind)).alias("k"), s["a"].alias("a"), s["b"].alias("b")))

    return F.concat(*map(of, BASE))


def listed(spans: Column) -> Column:
    """kind:start:end, by kind as listed, then start, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.get(names, s["k"]), s["a"].cast("string"), s["b"].cast("string"))), ",")


def neighbour(c: Column) -> Column:
    """Class of a neighbouring character; '' where there is none."""
    return F.when(c.rlike(r"^\s?$"), 0).when(c.rlike("^[A-Za-z]"), 1).when(c.rlike("^[0-9]"), 2) \
        .when(c.rlike("^[\"']"), 3).when(c.rlike("^[=:/#]"), 4).when(c.rlike(r"^[.,;!?)\]]"), 5).otherwise(6)


def features(kind: int, c: Column) -> Column:
    """array<int> of a located candidate."""
    m, before, after = c["m"], c["before"], c["after"]
    level = lambda n, step=1: F.least(F.floor(n / step).cast("int"), F.lit(LEVELS - 1))
    groups = F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0))
    return let(groups, lambda g: F.array(
        F.lit(kind), level(F.length(m), 2), level(F.length(digits(m))),
        level(F.regexp_count(m, F.lit("[A-Za-z]")), 2), level(F.regexp_count(m, F.lit("[^A-Za-z0-9.+]"))), level(F.size(g)),
        level(F.coalesce(F.array_max(F.transform(g, F.length)), F.lit(0))),
        level(F.coalesce(F.length(F.element_at(F.when(F.size(g) > 0, g), -1)), F.lit(0))),
        F.when(m.rlike(r"[^\x00-\x7F]"), 1).otherwise(0),
        neighbour(F.right(before, F.lit(1))), neighbour(F.left(after, F.lit(1))),
        F.when(before.rlike(CUES), 1).otherwise(0), F.when(before.rlike(DECOYS), 1).otherwise(0),
        level(F.regexp_count(F.concat(before, after), F.lit("[0-9]")), 2)))


FEATURES = 14


def holds_base(kind: str, m: Column) -> Column:
    """Whether a base span of the kind lies in a candidate."""
    pattern, test = RULES[kind]
    if test is None:
        return m.rlike(pattern)
    return F.exists(F.regexp_extract_all(m, F.lit(pattern), F.lit(0)), test)


def candidates(text: Column) -> Column:
    """array<struct<k, a, b, f, y>>: what the generators propose, its features,
    and whether it holds a base span."""
    def of(k: int, kind: str) -> Column:
        return F.transform(located(text, GENERATORS[kind], context=CONTEXT, needs=NEEDS[kind][1]), lambda c: F.struct(
            F.lit(len(BASE) + k).alias("k"), c["a"].alias("a"), c["b"].alias("b"),
            features(k, c).alias("f"), holds_base(kind, c["m"]).alias("y")))

    return F.concat(*(of(k, kind) for k, kind in enumerate(BASE)))


@dataclass
class Node:
    """A tree: a test ``f[feature] <= value``, or a leaf's ``score``."""
    score: float = 0.0
    feature: int = -1
    value: int = 0
    low: Node | None = None
    high: Node | None = None

    def column(self, f: Column, leaf: Callable[[Node], Column]) -> Column:
        if self.feature < 0:
            return leaf(self)
        return F.when(F.get(f, F.lit(self.feature)) <= self.value, self.low.column(f, leaf)) \
            .otherwise(self.high.column(f, leaf))

    def leaves(self) -> list[Node]:
        return [self] if self.feature < 0 else [*self.low.leaves(), *self.high.leaves()]


@dataclass
class Model:
    """Boosted trees and the least score of every generator (none: 2)."""
    bias: float = 0.0
    trees: list[Node] = field(default_factory=list)
    thresholds: list[float] = field(default_factory=lambda: [2.0] * len(BASE))

    def score(self, f: Column) -> Column:
        margin = F.lit(self.bias)
        for tree in self.trees:
            margin = margin + tree.column(f, lambda leaf: F.lit(leaf.score))
        return 1 / (1 + F.exp(-margin))

    def selected(self, c: Column) -> Column:
        least = F.get(F.array(*map(F.lit, self.thresholds)), c["k"] - len(BASE))
        return F.when(least > 1, F.lit(False)).otherwise(~c["y"] & (self.score(c["f"]) >= least))


def examples(docs: DataFrame, text_col: str, sample: int | None = None) -> DataFrame:
    """(f, y, held, w): distinct feature rows of all candidates with the number
    of texts that have them. Copies, told by a hash of the text, count once.
    With ``sample``, only of about so many documents, chosen by that hash."""
    rows = docs.select(text_or_empty(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    if sample is not None:
        share = min(1.0, sample / max(docs.count(), 1))
        rows = rows.filter(F.pmod("h", F.lit(1 << 20)) < math.ceil(share * (1 << 20)))
    found = rows.select("h", F.explode(candidates(F.col("text"))).alias("c")).select("h", "c.f", "c.y")
    held = F.pmod(F.shiftrightunsigned("h", 20), F.lit(FOLDS)) == 0
    return found.distinct().groupBy("f", "y", held.alias("held")).agg(F.count("*").alias("w"))


def best_split(sums: dict[tuple[int, int], tuple[int, int]]) -> tuple[float, int, int]:
    """(gain, feature, value) of one node's sums by (feature, value)."""
    best = (0.0, -1, 0)
    for feature in range(FEATURES):
        values = sorted(v for f, v in sums if f == feature)
        whole = [sum(sums[feature, v][i] for v in values) for i in (0, 1)]
        g = h = 0
        for v in values[:-1]:
            g, h = g + sums[feature, v][0], h + sums[feature, v][1]
            parts = ((g, h), (whole[0] - g, whole[1] - h))
            gain = sum((a / UNIT) ** 2 / (b / UNIT + RIDGE) for a, b in parts) \
                - (whole[0] / UNIT) ** 2 / (whole[1] / UNIT + RIDGE)
            if min(b for _, b in parts) >= UNIT and gain > best[0] + 1e-9:
                best = (gain, feature, v)
    return best


def grown(rows: DataFrame, model: Model) -> Node:
    """One more tree for ``model``: per level one aggregation of the gradients
    and second derivatives of the logistic loss."""
    root = Node()
    p = model.score(F.col("f"))
    g = F.round((p - F.col("y").cast("int")) * UNIT).cast("long") * F.col("w")
    h = F.round(p * (1 - p) * UNIT).cast("long") * F.col("w")
    for level in range(DEPTH + 1):
        leaves = root.leaves()
        place = {id(leaf): i for i, leaf in enumerate(leaves)}
        node = root.column(F.col("f"), lambda leaf: F.lit(place[id(leaf)]))
        sums: list[dict] = [{} for _ in leaves]
        for i, feature, value, a, b in rows.select(node.alias("n"), g.alias("g"), h.alias("h"), F.posexplode("f")) \
                .groupBy("n", "pos", "col").agg(F.sum("g"), F.sum("h")).collect():
            sums[i][feature, value] = (a, b)
        for leaf, own in zip(leaves, sums):
            total = [sum(v[i] for (f, _), v in own.items() if f == 0) for i in (0, 1)]
            leaf.score = -RATE * total[0] / (total[1] + RIDGE * UNIT)
            _, feature, value = best_split(own) if level < DEPTH else (0, -1, 0)
            if feature >= 0:
                leaf.feature, leaf.value, leaf.low, leaf.high = feature, value, Node(), Node()
        if all(leaf.feature < 0 for leaf in leaves):
            break
    return root


def thresholds(rows: DataFrame, model: Model, precision: float, support: int) -> list[float]:
    """Per generator the least score, in steps of 1 / SCORES, from which at
    least ``precision`` of the held-out candidates hold a base span."""
    step = F.floor(model.score(F.col("f")) * SCORES).cast("int")
    counts = {(k, s): (n, y) for k, s, n, y in rows.groupBy(F.get("f", F.lit(0)).alias("k"), step.alias("s")).agg(
        F.sum("w"), F.sum(F.when(F.col("y"), F.col("w")).otherwise(0))).collect()}
    out = []
    for k in range(len(BASE)):
        least, n, y = 2.0, 0, 0
        for s in range(SCORES, -1, -1):
            more = counts.get((k, s), (0, 0))
            n, y = n + more[0], y + more[1]
            if more[0] and n >= support and y >= precision * n:
                least = s / SCORES
        out.append(least)
    return out


def fit(docs: DataFrame, text_col: str = "text", sample: int | None = None, precision: float = PRECISION,
        support: int = SUPPORT) -> Model:
    """Trees and thresholds learned from all rows (of about ``sample``, if given)."""
    rows = materialize(examples(docs, text_col, sample), "candidates")
    learned, held = rows.filter(~F.col("held")), rows.filter("held")
    n, y = learned.agg(F.coalesce(F.sum("w"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("y"), F.col("w"))), F.lit(0))).first()
    if not 0 < y < n:  # nothing to tell apart
        return Model()
    model = Model(bias=math.log(y / (n - y)))
    for _ in range(TREES):
        model.trees.append(grown(learned, model))
    model.thresholds = thresholds(held, model, precision, support)
    return model


def with_spans(docs: DataFrame, text: str, model: Model, base: str, added: str) -> DataFrame:
    """``docs`` with two arrays of struct<k, a, b>: base spans and added ones."""
    more = F.transform(F.filter(candidates(F.col(text)), model.selected), lambda c: F.struct(
        c["k"].alias("k"), c["a"].alias("a"), c["b"].alias("b")))
    return docs.withColumns({base: base_spans(F.col(text)), added: more})


def pii_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """One row per document: counts of the base kinds, all spans."""
    model = model or fit(docs, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    rows = with_spans(rows, "text", model, "base", "added").select("doc_id", "base", "added")
    count = lambda k: F.size(F.filter(F.col("base"), lambda s: s["k"] == k)).cast("long")
    return rows.select(
        "doc_id", *(count(k).alias(f"n_{kind}") for k, kind in enumerate(BASE)),
        F.size("added").cast("long").alias("n_added"), F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.concat("base", "added")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[private]", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """``docs`` with every span's characters replaced by ``mark`` (overlapping
    spans as one); all other columns stay as they are, null text stays null."""
    model = model or fit(docs, text_col)
    taken = {c.lower() for c in docs.columns}
    names = []
    for name in ("pii_text", "pii_base", "pii_added"):
        while name in taken:
            name += "_"
        names.append(name)
    t, base, added = names
    rows = with_spans(docs.withColumn(t, text_or_empty(text_col)), t, model, base, added)
    spans = F.array_sort(F.transform(F.concat(F.col(base), F.col(added)), lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"))))
    text = F.when(F.col(text_col).isNotNull(), let(spans, lambda s: redacted(F.col(t), s, mark)))
    return rows.withColumn(text_col, text).select(*docs.columns)
