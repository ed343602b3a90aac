"""Licence notices by Dice coefficient over word bigrams, in DataFrame operations only.

A text is cut into units: its lines, the sentences of a line that has several, and
paragraphs of several lines. A unit is normalised (small letters, digits, single
spaces) and its set A of word bigrams compared to the set B of each template:
dice = 2 |A and B| / (|A| + |B|). Before that,

* a template is a candidate only if |A| lies between t / (2 - t) |B| and
  (2 - t) / t |B|, outside of which the coefficient cannot reach t;
* a unit is dropped if even all its bigrams known to any template could not reach
  t against the smallest candidate.

Both bounds are exact. So is the one that most texts stop at: a unit that reaches the
threshold shares so many bigrams with its template that at least one of them holds an
anchor word; texts and units without any anchor word are passed over. The anchors are
chosen from the templates by that rule. Null and empty texts have no units with bigrams and give no
rows; repeated rows give their rows again; equal scores are all returned. Texts of any
length are cut into units whole; an empty table gives no rows; columns other than id and
text, whatever their names, are left out.
"""

from __future__ import annotations

import math
import operator
import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.binding import let

THRESHOLD = 0.8
UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARAGRAPH_GAP = r"\n[\x20\x09-\x0D]*\n"
SENTENCE_GAP = r"[.;!?][\x20\x09]+"

# Public licence notices and short licence texts.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", "This project is licensed under the terms of the MIT license."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("bsd", "Released under the BSD License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd-3-clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "All rights reserved."),
)


def plain_bigrams(text: str) -> set[str]:
    """The bigrams of a template; texts of the table get theirs from ``bigrams``."""
    words = re.sub("[^a-z0-9]+", " ", text.translate(str.maketrans(UPPER, SMALL))).strip(" ").split(" ")
    return {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}


def bigrams(text: Column) -> Column:
    """The distinct word bigrams of a normalised text."""
    words = F.split(F.trim(F.regexp_replace(F.translate(text, UPPER, SMALL), "[^a-z0-9]+", " ")), " ")
    pairs = let(words, lambda w: F.when(F.size(w) > 1, F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b))))
    return F.coalesce(F.array_distinct(pairs), F.array().cast("array<string>"))


def units(text: Column) -> Column:
    """Lines, sentences and paragraphs as an array of (unit, place, part, text)."""

    def one(kind: str, at: Column, part: Column, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("unit"), at.cast("int").alias("place"), part.cast("int").alias("part"), value.alias("text"))

    def of_lines(lines: Column) -> Column:
        whole = F.transform(lines, lambda line, i: one("line", i, F.lit(0), line))
        parts = F.transform(
            lines,
            lambda line, i: let(F.split(line, SENTENCE_GAP, -1), lambda s: F.filter(F.transform(s, lambda x, k: one("sentence", i, k, x)), lambda _: F.size(s) > 1)),
        )
        return F.concat(whole, F.flatten(parts))

    paragraphs = F.filter(F.transform(F.split(text, PARAGRAPH_GAP, -1), lambda p, i: one("paragraph", i, F.lit(0), p)), lambda p: F.contains(p["text"], F.lit("\n")))
    return F.concat(let(F.split(text, "\n", -1), of_lines), paragraphs)


def anchor_words(sets: list[set[str]], threshold: float) -> list[str]:
    """Words of which every unit that reaches the threshold against some template holds at least one.

    A unit with |A| bigrams shares at least t (|A| + |B|) / 2 of them, and |A| is at least
    t / (2 - t) |B|. Once fewer bigrams of a template are without an anchor than
    that, a shared one has an anchor.
    """
    needed = [math.ceil(threshold * (math.ceil(threshold / (2 - threshold) * len(s) - 1e-9) + len(s)) / 2 - 1e-9) for s in sets]
    open_ = [{g for g in s} for s in sets]
    chosen: list[str] = []
    while any(len(s) >= n for s, n in zip(open_, needed, strict=True)):
        gain: Counter[str] = Counter()
        for s, n in zip(open_, needed, strict=True):
            if len(s) >= n:
                gain.update(w for g in s for w in set(g.split(" ")))
        word = max(gain, key=lambda w: (min(len(w), 5), gain[w], w))
        chosen.append(word)
        open_ = [{g for g in s if word not in g.split(" ")} for s in open_]
    return chosen


def has_anchor(text: Column, anchors: list[str]) -> Column:
    """Whether a text may hold an anchor word; small letters come from ``lower``, which maps A-Z as the normalisation does."""
    return let(F.lower(text), lambda low: reduce(operator.or_, [F.contains(low, F.lit(w)) for w in anchors]))


def scan_licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per unit and template that reach the threshold.

    Columns: doc_id, unit, place, part, license, template (its number), n_bigrams, dice.
    """
    sets = [plain_bigrams(text) for _, text in templates]
    known = sorted(set().union(*sets))
    low, high = threshold / (2 - threshold) - 1e-9, (2 - threshold) / threshold + 1e-9  # bounds may be met exactly
    sizes = sorted({len(s) for s in sets})
    table = F.array(
        *[
            F.struct(F.lit(name).alias("license"), F.lit(k).alias("template"), F.lit(len(s)).alias("b"), F.array(*[F.lit(x) for x in sorted(s)]).alias("grams"))
            for k, ((name, _), s) in enumerate(zip(templates, sets, strict=True))
        ]
    )

    def compare(own: Column) -> Column:
        scored = F.transform(
            F.filter(table, lambda t: (F.size(own) >= low * t["b"]) & (F.size(own) <= high * t["b"])),
            lambda t: F.struct(t["license"].alias("license"), t["template"].alias("template"), (2.0 * F.size(F.array_intersect(own, t["grams"])) / (F.size(own) + t["b"])).alias("dice")),
        )
        return F.filter(scored, lambda m: m["dice"] >= threshold)

    def could(own: Column) -> Column:
        """Whether the smallest candidate template is within reach of the unit's known bigrams."""
        smallest = F.element_at(F.filter(F.array(*[F.lit(b) for b in sizes]), lambda b: (F.size(own) >= low * b) & (F.size(own) <= high * b)), 1)
        shared = F.size(F.filter(own, lambda g: g.isin(known)))
        return 2 * shared >= threshold * (F.size(own) + smallest)

    none = F.array().cast("array<struct<license:string,template:int,dice:double>>")
    bounded = lambda own: (F.size(own) >= low * sizes[0]) & (F.size(own) <= high * sizes[-1])
    found = let(
        bigrams(F.col("u.text")),
        lambda own: F.struct(F.size(own).alias("n"), F.when(bounded(own), F.when(F.coalesce(could(own), F.lit(False)), compare(own)).otherwise(none)).otherwise(none).alias("matches")),
    )
    anchors = anchor_words(sets, threshold)
    near = docs.where(has_anchor(F.col("text"), anchors)).select("doc_id", "text")
    cut = near.select(F.col("doc_id"), F.explode(units(F.col("text"))).alias("u")).where(has_anchor(F.col("u.text"), anchors))
    scored = cut.select("doc_id", "u.unit", "u.place", "u.part", F.explode(F.array(found)).alias("f"))
    return scored.select("doc_id", "unit", "place", "part", F.col("f.n").alias("n_bigrams"), F.explode("f.matches").alias("m")).select(
        "doc_id", "unit", "place", "part", "m.license", "m.template", "n_bigrams", "m.dice"
    )
