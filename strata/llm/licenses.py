r"""License scan: Dice coefficient of word bigrams against licence templates.

A text is cut into sentences (at line ends and after . ! ? and white space)
and into paragraphs (at blank lines); a sentence that goes over line ends inside
a longer paragraph is also a segment as a whole ("wrapped"), reported unless its
paragraph or one of its lines has the same licence. A segment is normalised to lower-case
words [a-z0-9]+, and its distinct word bigrams are compared with each
template's: dice = 2 * common / (segment + template). Templates whose size rules
out the threshold are pruned first: dice >= t needs a segment of t / (2 - t) up
to (2 - t) / t times the template's bigrams. A segment reports its best template
(ties: the first listed). Texts and segments without any anchor are skipped:
every template needs so many common bigrams that at least one of its anchors
is among them, so nothing is lost.

Templates are notices (a form and a licence's name), the usual file headers,
and the licence texts of ``license_texts/``: each of their paragraphs, and each
text as a whole, as a comment block holds it. Paragraphs whose bigrams all stand
in a paragraph of another licence as well prove neither and are left out, as
are headings and copyright lines.

Built-in functions only, no shuffle. Null text counts as empty (no notice).
An empty table gives no rows; repeated rows are judged each by itself; other
columns of the input are ignored.
"""

from __future__ import annotations

import functools
import math
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

THRESHOLD = 0.8

#: Licences (SPDX id -> kind, names under which notices cite them).
LICENSES = {
    "MIT": ("permissive", ("the MIT License",)),
    "Apache-2.0": ("permissive", ("the Apache License, Version 2.0",)),
    "BSD-2-Clause": ("permissive", ("the BSD 2-Clause License",)),
    "BSD-3-Clause": ("permissive", ("the BSD 3-Clause License",)),
    "ISC": ("permissive", ("the ISC License",)),
    "MPL-2.0": ("weak copyleft", ("the Mozilla Public License, version 2.0",)),
    "LGPL-3.0": ("weak copyleft", ("the GNU Lesser General Public License, version 3",)),
    "GPL-2.0": ("copyleft", ("the GNU General Public License, version 2",)),
    "GPL-3.0": ("copyleft", ("the GNU General Public License, version 3",)),
    "AGPL-3.0": ("copyleft", ("the GNU Affero General Public License, version 3",)),
    "CC0-1.0": ("public domain", ("CC0 1.0",)),
    "CC-BY-4.0": ("permissive", ("CC BY 4.0",)),
    "CC-BY-SA-4.0": ("copyleft", ("CC BY-SA 4.0",)),
    "CC-BY-NC-4.0": ("non-commercial", ("CC BY-NC 4.0",)),
    "CC-BY-ND-4.0": ("no derivatives", ("CC BY-ND 4.0",)),
    "CC-BY-NC-SA-4.0": ("non-commercial", ("CC BY-NC-SA 4.0",)),
    "CC-BY-NC-ND-4.0": ("non-commercial", ("CC BY-NC-ND 4.0",)),
    "LGPL-2.1": ("weak copyleft", ("the GNU Lesser General Public License, version 2.1",)),
}
#: The forms of a notice.
FORMS = ("Licensed under {}", "Released under {}", "This work is licensed under {}",
         "This file is distributed under the terms of {}")
#: Permission statements that stand without a licence's name.
STATEMENTS = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
           "associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
           "is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted "
                    "provided that the following conditions are met",
}
#: Further wordings of notices. With another name in it, none of
#: them reaches the threshold.
MORE_FORMS = ("This project is licensed under {}", "This software is licensed under {}", "Distributed under {}")
SPDX_LINE = "SPDX-License-Identifier: {}"
#: Further names (SPDX id -> names). The Creative Commons licences
#: are named by their elements.
MORE_NAMES = {
    "Apache-2.0": ("the Apache License 2.0", "the Apache 2.0 License"),
    "MPL-2.0": ("the Mozilla Public License 2.0",),
    "LGPL-2.1": ("the GNU Lesser General Public License v2.1",),
    "LGPL-3.0": ("the GNU Lesser General Public License v3.0",),
    "GPL-2.0": ("the GNU General Public License v2.0",),
    "GPL-3.0": ("the GNU General Public License v3.0",),
    "AGPL-3.0": ("the GNU Affero General Public License v3.0",),
    **{f"CC-{code}-4.0": tuple(f"{article} Creative Commons {name} 4.0 International License" for article in ("a", "the"))
       for code, name in (
           ("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"),
           ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
           ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))},
}
#: File headers as one block, as comments hold them.
GNU_HEADER = ("This {what} is free software: you can redistribute it and/or modify it under the terms of the {name} as "
              "published by the Free Software Foundation, either version {version} of the License, or (at your option) any "
              "later version. This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
              "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for "
              "more details. You should have received a copy of the {name} along with this {what}. If not, see "
              "<https://www.gnu.org/licenses/>.")
GNU = {"GPL-2.0": ("program", "GNU General Public License", "2"),
       "GPL-3.0": ("program", "GNU General Public License", "3"),
       "AGPL-3.0": ("program", "GNU Affero General Public License", "3"),
       "LGPL-2.1": ("library", "GNU Lesser General Public License", "2.1"),
       "LGPL-3.0": ("library", "GNU Lesser General Public License", "3")}
APACHE_HEADER = ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                 "compliance with the License. You may obtain a copy of the License at "
                 "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
                 "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
                 "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
                 "permissions and limitations under the License.")
#: Licence texts, <SPDX id>.txt; paragraphs of fewer bigrams are headings or lists' ends.
TEXTS = Path(__file__).with_name("license_texts")
PARAGRAPH_LEAST = 12


def bigrams(text: str) -> list[str]:
    words = re.findall("[a-z0-9]+", text.lower())
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def texts() -> dict[str, str]:
    out = {spdx: path.read_text(encoding="utf-8") for spdx in LICENSES if (path := TEXTS / f"{spdx}.txt").exists()}
    # of AGPL-3.0 the sections that it shares with GPL-3.0, under its own name
    return out | {"AGPL-3.0": re.sub("GNU(\\s+)General", r"GNU\1Affero General", re.sub(
        "GNU(\\s+)GENERAL", r"GNU\1AFFERO GENERAL", out["GPL-3.0"]))}


def text_templates() -> list[tuple[str, list[str]]]:
    """Paragraphs that are one licence's own, then the texts as a whole."""
    whole = texts()
    parts = [(spdx, p, bigrams(p)) for spdx, text in whole.items() for p in re.split(r"\n[ \t\r\f]*\n", text)]
    sets = [(spdx, set(g)) for spdx, _, g in parts]
    own = [(spdx, g) for spdx, p, g in parts
           if len(g) >= PARAGRAPH_LEAST and not re.match(r"\s*copyright\b", p, re.I)
           and not any(x != spdx and other.issuperset(g) for x, other in sets)]
    return own + [(spdx, bigrams(text)) for spdx, text in whole.items()]


@functools.cache
def templates() -> list[tuple[str, list[str]]]:
    out = [(spdx, bigrams(form.format(name))) for spdx, (_, names) in LICENSES.items()
           for name in names for form in FORMS]
    out += [(spdx, bigrams(text)) for spdx, text in STATEMENTS.items()]
    for spdx, (_, names) in LICENSES.items():
        more = MORE_NAMES.get(spdx, ())
        out += [(spdx, bigrams(form.format(name))) for name in names for form in MORE_FORMS]
        out += [(spdx, bigrams(form.format(name))) for name in more for form in FORMS + MORE_FORMS]
        out.append((spdx, bigrams(SPDX_LINE.format(spdx))))
    out += [(spdx, bigrams(GNU_HEADER.format(what=what, name=name, version=version)))
            for spdx, (what, name, version) in GNU.items()]
    return out + [("Apache-2.0", bigrams(APACHE_HEADER))] + text_templates()


def anchors(table: list[tuple[str, list[str]]], threshold: float) -> list[str]:
    """Bigrams of which any segment that reaches the threshold has one: per
    template all but (least overlap - 1) of its bigrams, those that are anchors
    already and the longest ones."""
    out: dict[str, None] = {}
    for _, grams in sorted(table, key=lambda t: len(t[1])):
        # a segment has at least as many bigrams as it shares: overlap >= t / (2 - t) * size
        need = math.ceil(threshold / (2 - threshold) * len(grams) - 1e-9)
        out.update(dict.fromkeys(sorted(grams, key=lambda g: (g not in out, -len(g), g))[:len(grams) - need + 1]))
    return list(out)


def any_of(words: list[str]) -> str:
    """A regular expression of the words (letters, digits, blanks) as a tree of
    their beginnings, so that a text is compared with few of them at a time;
    the blank is any gap."""
    tree: dict = {}
    for w in words:
        at = tree
        for c in w:
            at = at.setdefault(c, {})
        at[""] = {}

    def pattern(at: dict) -> str:
        ways = [("[^A-Za-z0-9]+" if c == " " else c) + pattern(below) if c else "(?![a-z0-9])"
                for c, below in sorted(at.items())]
        return ways[0] if len(ways) == 1 else "(?:" + "|".join(ways) + ")"

    return "(?i)(?<![a-z0-9])" + pattern(tree)


def segments(text: Column, pattern: str) -> Column:
    """Sentences, paragraphs, and wrapped sentences that have an anchor; these
    with the texts that report the same notice if they reach the threshold."""
    none = F.lit(None).cast("array<string>")
    sentences = F.split(text, r"\n|(?<=[.!?])\s+", -1)
    paragraphs = F.filter(F.split(text, r"\n[ \t\r]*\n", -1), lambda p: p.rlike(r"\n|[.!?]\s"))

    def wrapped(p: Column) -> Column:
        pieces = F.filter(F.split(p, r"(?<=[.!?])\s+", -1), lambda s: (s != p) & s.contains("\n") & s.rlike(pattern))
        return F.transform(pieces, lambda s: F.struct(
            F.lit("wrapped").alias("level"), s.alias("text"),
            F.transform(F.concat(F.array(p), F.split(s, "\n", -1)), stripped).alias("parts")))

    return F.concat(
        F.transform(sentences, lambda s: F.struct(F.lit("sentence").alias("level"), s.alias("text"), none.alias("parts"))),
        F.transform(paragraphs, lambda p: F.struct(F.lit("paragraph").alias("level"), p.alias("text"), none.alias("parts"))),
        F.flatten(F.transform(paragraphs, wrapped)))


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def best_match(segment: Column, table: list[tuple[str, list[str]]], threshold: float) -> Column:
    """struct<dice, rank>: the segment's best template, null below the threshold."""
    known = F.expr("array(" + ", ".join("named_struct('i', {}, 'g', array({}))".format(i, ", ".join(f"'{x}'" for x in g))
                                        for i, (_, g) in enumerate(table)) + ")")
    words = F.filter(F.split(F.lower(segment), "[^a-z0-9]+", -1), lambda w: w != "")

    def grams(w: Column) -> Column:
        n = F.greatest(F.size(w) - 1, F.lit(0))
        return F.array_distinct(F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n),
                                           lambda a, b: F.concat(a, F.lit(" "), b)))

    def compare(g: Column) -> Column:
        fitting = F.filter(known, lambda t: (F.size(g) >= F.size(t["g"]) * (threshold / (2 - threshold)) - 1e-9)
                           & (F.size(g) <= F.size(t["g"]) * ((2 - threshold) / threshold) + 1e-9))
        scored = F.transform(fitting, lambda t: F.struct(
            (F.size(F.array_intersect(g, t["g"])) * 2.0 / (F.size(g) + F.size(t["g"]))).alias("dice"),
            (-t["i"]).alias("rank")))
        return F.array_max(F.filter(scored, lambda s: s["dice"] >= threshold))

    return let(words, lambda w: let(grams(w), compare))


def with_notices(docs: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """doc_id and an array of the notices found, in text order."""
    table = templates()
    names = F.array(*(F.lit(spdx) for spdx, _ in table))
    pattern = any_of(anchors(table, threshold))
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    parts = F.when(F.col("text").rlike(pattern), segments(F.col("text"), pattern)) \
        .otherwise(F.array().cast("array<struct<level:string,text:string,parts:array<string>>>"))
    scored = F.transform(parts, lambda s, i: F.struct(
        i.alias("segment"), s["level"].alias("level"),
        F.when(s["text"].rlike(pattern), best_match(s["text"], table, threshold)).alias("m"),
        s["text"].alias("text"), s["parts"].alias("parts")))
    notices = F.transform(F.filter(scored, lambda s: s["m"].isNotNull()), lambda s: F.struct(
        s["segment"], s["level"], F.get(names, -s["m"]["rank"]).alias("license"),
        s["m"]["dice"].alias("dice"), s["text"], s["parts"]))
    found = let(notices, lambda fs: F.transform(F.filter(fs, lambda f: f["parts"].isNull() | ~F.exists(fs, lambda o: (
        o["parts"].isNull() & (o["license"] == f["license"]) & F.array_contains(f["parts"], stripped(o["text"]))))),
        lambda f: F.struct(f["segment"], f["level"], f["license"], f["dice"], f["text"])))
    return rows.select("doc_id", found.alias("found"))


def license_notices(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    threshold: float = THRESHOLD) -> DataFrame:
    """One row per notice: doc_id, segment, level, license, dice, text."""
    return with_notices(docs, id_col, text_col, threshold) \
        .select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.*")


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: notices found, licences and their kinds (sorted,
    comma-joined), and the best match with its coefficient (null: none)."""
    kinds = F.create_map(*(F.lit(x) for spdx, (kind, _) in LICENSES.items() for x in (spdx, kind)))
    rows = with_notices(docs, id_col, text_col, threshold)
    ids = F.array_sort(F.array_distinct(F.transform("found", lambda f: f["license"])))
    # highest coefficient, then the earliest segment
    best = F.array_max(F.transform("found", lambda f: F.struct(
        f["dice"].alias("dice"), (-f["segment"]).alias("at"), f["license"].alias("license"))))
    return rows.select(
        "doc_id", F.size("found").cast("long").alias("n_notices"), F.array_join(ids, ",").alias("licenses"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(ids, lambda x: F.element_at(kinds, x)))), ",").alias("kinds"),
        best["license"].alias("best_license"), best["dice"].alias("best_dice"))
