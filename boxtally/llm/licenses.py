"""Licence notices in documents, by native expressions.

Candidates are the lines of a text and its paragraphs of several lines, which blank lines separate. The words and
word pairs of a candidate are looked up in the weights of a multinomial logistic regression over licence families
and an unknown class; probabilities are calibrated with a temperature fitted on training rows that were held out.
Hyphens and dots separate words, so that GPL-2.0-only has the words of GPL 2.0. A predicted family is confirmed when
the candidate shares enough word pairs with one of the family's templates, in proportion to the shorter of the two.

A candidate is passed over only if it is unknown for certain: the n-grams outside ``decisive`` together cannot lift
any family to the unknown class, so a text without a decisive n-gram names no family. Equal notices are compared
with the templates once and joined back to their places.

The classifier is trained on the driver from the templates below, shortened and embedded in other words, against at
most ``MAX_OTHERS`` paragraphs of the corpus that share no word triple with a template. The weights are a table of a
few thousand rows whatever the corpus, and are broadcast.

Defined results: null, empty and blank texts have no candidates. Repeated rows and ids give rows each. A row is
returned for each line that names a family, and for each line with a cue word, whose ``family`` is ``unknown`` where
no family reaches ``LEAST``. A paragraph of several lines has a row, numbered by its first line and with its line
breaks, when it names a family that none of its lines names, or confirms one that none of them confirms. Of equal
probabilities the family first by name wins. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxtally.session import cut_lineage

UNKNOWN = "unknown"
#: Calibrated probability from which a family is named, and share of word pairs that confirms it.
LEAST = 0.5
CONFIRM = 0.6
#: Paragraphs of the corpus that stand for other text in training, at most.
MAX_OTHERS = 2000
#: Words with which a line has a row even if it names no family.
CUES = (
    "license licence licensed licenced licensing licenses licences sublicense copyright copyrighted copyleft apache gnu gpl gplv2 gplv3 lgpl agpl mozilla mpl "
    "cc0 cc-by cc-by-sa cc-by-nc by-sa by-nc by-nd by-nc-sa by-nc-nd unlicense spdx-license-identifier redistribution redistributions warranty warranties "
    "merchantability noninfringement dedicated waived"
).split()
#: Notices of each family.
TEMPLATES = {
    "Apache": [
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Licensed under the Apache License, Version 2.0.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "This project is released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
        "Available under Apache-2.0.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "This software is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, to deal in the Software without restriction, including the rights to use, copy, modify, merge, publish, distribute, sublicense, and sell copies.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
        "MIT-licensed code.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Distributed under the terms of the GPL version 2 license.",
        "Released under the GNU GPL v3 license.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Available under GPL-2.0-only.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "You can redistribute this library under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "Released under the LGPL license.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "AGPL": [
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "Released under the AGPL license.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "Available under AGPL-3.0-only.",
    ],
    "BSD": [
        "Licensed under the BSD 3-Clause License.",
        "Released under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Available under BSD-3-Clause.",
    ],
    "MPL": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, Version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "Available under MPL-2.0.",
    ],
    "ISC": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Content is available under the Creative Commons Attribution license.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Content is available under the Creative Commons Attribution-NonCommercial license.",
    ],
    "CC0": [
        "Dedicated to the public domain under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0.",
        "This is free and unencumbered software dedicated to the public domain under the Unlicense.",
        "This is free and unencumbered software released into the public domain.",
    ],
}
#: Sentences with cue words that name no family.
OTHERS = [
    "He lost his driving license last year.", "The licence fee will rise in April.", "A warranty of two years covers all parts.",
    "Copyright law protects the authors of books.", "All rights reserved. Copyright 2020 by the publisher.", "The restaurant applied for a license to sell wine.",
    "The Apache helicopter landed near the village.", "The gnu grazed on the plain.", "She is a licensed nurse.", "He dedicated his life to music.",
    "The redistribution of wealth was debated.", "Licensed premises close at midnight.", "The fee was waived for students.", "Mozilla hired new engineers.",
    "You may need a license for this area.", "The terms of the license were not disclosed.", "A copy of the licence is kept at the office.",
    "Released under license from the owner.", "This product is sold under a commercial license.", "Licensed to the company under contract.",
]
_TOKEN = r"[\p{L}\p{N}]+"


def tokens(text: str) -> list[str]:
    """The words of a paragraph, as ``_words`` finds them."""
    return re.findall(r"[^\W_]+", text.lower())


def ngrams(words: Sequence[str]) -> list[str]:
    """Distinct words and word pairs of a paragraph."""
    return list(dict.fromkeys([*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]))


def _words(paragraph: Column) -> Column:
    return F.regexp_extract_all(F.lower(paragraph), F.lit(_TOKEN), F.lit(0))


def _any_of(phrases: Sequence[str]) -> str:
    """A pattern for lower-case text that holds one of the phrases as whole words; a tree of letters, so that a place costs few steps."""
    tree: dict = {}
    for phrase in phrases:
        at = tree
        for letter in [*" ".join(tokens(phrase)), ""]:
            at = at.setdefault(letter, {})

    def pattern(node: dict) -> str:
        ways = [r"(?![\p{L}\p{N}])" if not c else (r"[^\p{L}\p{N}]+" if c == " " else re.escape(c)) + pattern(below) for c, below in sorted(node.items())]
        return "" if not node else ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})"

    return r"(?<![\p{L}\p{N}])" + pattern(tree)


def _pairs(words: Column) -> Column:
    """Word pairs in order; none for fewer than two words."""
    return F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))


@dataclass
class Model:
    """Weights per n-gram and family (in order of name, unknown last), intercepts and the calibrating temperature."""

    families: list[str]
    grams: list[str]
    weights: np.ndarray
    intercept: np.ndarray
    temperature: float

    def probabilities(self, text: str) -> np.ndarray:
        at = {g: i for i, g in enumerate(self.grams)}
        z = (self.intercept + sum((self.weights[at[g]] for g in ngrams(tokens(text)) if g in at), np.zeros(len(self.families)))) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()


def _examples(others: Sequence[str]) -> tuple[list[str], list[str], list[bool]]:
    """Training paragraphs, families, and which are held out: templates whole, cut at both ends and amid other words."""
    texts, families, held = [], [], []

    def add(text: str, family: str, out: bool) -> None:
        texts.append(text)
        families.append(family)
        held.append(out)

    fill = [o for o in others if o.strip()] or ["the", "of and"]
    for family, notices in TEMPLATES.items():
        for k, notice in enumerate(notices):
            words = notice.split()
            for turn in range(8):
                own = words[turn % 3 : len(words) - turn % 2] if len(words) > 8 else words
                around = fill[(31 * k + 7 * turn + len(texts)) % len(fill)].split()[: 12 * (turn % 3)]
                add(" ".join([*around[: turn % 5 * 2], *own, *around[turn % 5 * 2 :]]), family, turn % 4 == 3)
    for k, text in enumerate([*(OTHERS * 4), *others]):
        add(text, UNKNOWN, k % 4 == 3)
    return texts, families, held


def fit(others: Sequence[str], penalty: float = 0.02, steps: int = 400) -> Model:
    """Multinomial logistic regression by gradient steps, then a temperature chosen on the held-out rows."""
    texts, names, held_out = _examples(others)
    families = [*sorted(TEMPLATES), UNKNOWN]
    grams = sorted({g for notices in TEMPLATES.values() for n in notices for g in ngrams(tokens(n))} | {g for o in OTHERS for g in ngrams(tokens(o))})
    at = {g: i for i, g in enumerate(grams)}
    x = np.zeros((len(texts), len(grams)))
    for i, text in enumerate(texts):
        for g in ngrams(tokens(text)):
            if g in at:
                x[i, at[g]] = 1
    y = np.zeros((len(texts), len(families)))
    y[np.arange(len(texts)), [families.index(n) for n in names]] = 1
    held = np.array(held_out)
    # rows of a family weigh as much as all of another family together
    share = (y / np.maximum(y[~held].sum(axis=0), 1)).sum(axis=1)[~held]
    share = share / share.sum()
    w, b = np.zeros((len(grams), len(families))), np.zeros(len(families))
    move_w, move_b = np.zeros_like(w), np.zeros_like(b)
    for _ in range(steps):
        z = x[~held] @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        error = (p - y[~held]) * share[:, None]
        move_w = 0.9 * move_w - 4.0 * (x[~held].T @ error + penalty / len(grams) * w)
        move_b = 0.9 * move_b - 4.0 * error.sum(axis=0)
        w, b = w + move_w, b + move_b
    b[-1] = max(b[-1], b[:-1].max() + 3.0)  # without any feature a paragraph is unknown
    z = x[held] @ w + b

    def loss(t: float) -> float:
        top = (z / t).max(axis=1, keepdims=True)
        return float((np.log(np.exp(z / t - top).sum(axis=1)) + top[:, 0] - (z / t * y[held]).sum(axis=1)).mean())

    temperature = min(np.exp(np.linspace(-2, 2, 81)), key=loss)
    return Model(families, grams, w, b, float(temperature))


def decisive(model: Model, others: Sequence[str] = ()) -> list[str]:
    """N-grams one of which every paragraph that names a family holds.

    A family needs as much as the unknown class, so its n-grams have to make up for the difference of the
    intercepts. Those left out are chosen so that all of them together, each counted once, fall short of that for every
    family; the most frequent ones in ``others`` come first, because they are in most texts.
    """
    margin = np.maximum(model.weights[:, :-1] - model.weights[:, -1:], 0)
    gap = model.intercept[-1] - model.intercept[:-1] - 1e-6
    often = Counter(g for o in others for g in ngrams(tokens(o)))
    left, out = np.zeros(len(gap)), set()
    for i in sorted(range(len(model.grams)), key=lambda i: (-often[model.grams[i]], margin[i].max(), model.grams[i])):
        if (left + margin[i] < gap).all():
            left += margin[i]
            out.add(model.grams[i])
    kept = [g for g in model.grams if g not in out]
    words = {g for g in kept if " " not in g}
    return [g for g in kept if g in words or not words & set(g.split())]


def candidates(docs: DataFrame, grams: Sequence[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, paragraph_no, paragraph) of the lines and of the paragraphs of several lines that hold a cue word or one of ``grams``."""
    wanted = _any_of([*CUES, *grams])
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter(F.lower("text").rlike(wanted))
    rows = rows.select("doc_id", F.split("text", "\n").alias("lines"))
    lines = F.transform("lines", lambda line, i: F.struct(i.alias("no"), line.alias("paragraph")))
    # the first line of a paragraph carries its number through the split at blank lines
    blank = lambda line: ~line.rlike(r"\S")
    opens = lambda i: (i == 0) | blank(F.get(F.col("lines"), i - 1))
    marked = F.transform("lines", lambda line, i: F.when(blank(line), "").when(opens(i), F.concat(i.cast("string"), F.lit("\0"), line)).otherwise(line))
    blocks = F.transform(F.split(F.array_join(marked, "\n"), "\n\n+"), lambda b: F.btrim(b, F.lit("\n")))
    several = F.transform(F.filter(blocks, lambda b: F.contains(b, F.lit("\n"))), lambda b: F.struct(
        F.substring_index(b, "\0", 1).cast("int").alias("no"), F.substr(b, F.instr(b, "\0") + 1).alias("paragraph")
    ))
    each = rows.select("doc_id", F.explode(F.concat(lines, several)).alias("c")).select("doc_id", F.col("c.no").alias("paragraph_no"), "c.paragraph")
    return each.filter(F.lower("paragraph").rlike(wanted))


def other_paragraphs(docs: DataFrame, text_col: str = "text", most: int = MAX_OTHERS) -> list[str]:
    """A bounded sample of paragraphs, by smallest hash, that share no word triple with a template."""
    known = {tuple(w[i : i + 3]) for notices in TEMPLATES.values() for n in notices for w in [tokens(n)] for i in range(len(w) - 2)}
    # the first line of a document stands for it: one row per document keeps the draw cheap and spread over documents
    lines = docs.select(F.substring_index(F.col(text_col), "\n", 1).alias("p")).filter("p <> ''")
    few = max(1, docs.count() // (4 * most))  # so that the draw moves a few times ``most`` rows, whatever the number of tasks
    drawn = lines.select(F.substring("p", 1, 400).alias("p"), F.xxhash64("p").alias("h")).filter(F.pmod("h", F.lit(few)) == 0)
    rows = drawn.orderBy("h", "p").limit(most).collect()
    return [r["p"] for r in rows if not any(tuple(w[i : i + 3]) in known for w in [tokens(r["p"])] for i in range(len(w) - 2))]


def judge(rows: DataFrame, model: Model, *keep: str) -> DataFrame:
    """(row, ``keep``, family, probability) of rows (row, paragraph, ``keep``), whose numbers are unique; no paragraph is shuffled."""
    spark = rows.sparkSession
    names = [f"s{i}" for i in range(len(model.families))]
    # the empty n-gram, which no text has, stands in each row, so that rows without a known n-gram stay
    known = [(g, *map(float, row)) for g, row in zip(model.grams, model.weights)] + [("", *[0.0] * len(names))]
    weights = spark.createDataFrame(known, "gram string, " + ", ".join(f"{n} double" for n in names))
    words = rows.select("row", *keep, _words(F.col("paragraph")).alias("words"))
    grams = F.array_distinct(F.concat("words", _pairs(F.col("words")), F.array(F.lit(""))))
    found = words.select("row", *keep, F.explode(grams).alias("gram")).join(F.broadcast(weights), "gram")
    summed = found.groupBy("row", *keep).agg(*[F.sum(n).alias(n) for n in names])
    z = F.array(*[((F.col(n) + F.lit(float(b))) / F.lit(model.temperature)) for n, b in zip(names, model.intercept)])
    scored = summed.select("row", *keep, z.alias("z")).withColumn("top", F.array_max("z"))
    total = F.aggregate("z", F.lit(0.0), lambda acc, v: acc + F.exp(v - F.col("top")))
    families = F.array(*[F.lit(f) for f in model.families])
    named = scored.select("row", *keep, F.element_at(families, F.array_position("z", F.col("top")).cast("int")).alias("best"), (1 / total).alias("probability"))
    return named.select("row", *keep, F.when(F.col("probability") >= LEAST, F.col("best")).otherwise(UNKNOWN).alias("family"), F.round("probability", 6).alias("probability"))


def compare(named: DataFrame) -> DataFrame:
    """(digest, family, similarity, confirmed) of distinct named paragraphs (digest, family, paragraph)."""
    notices = [(f, n) for f, own in TEMPLATES.items() for n in own]
    templates = named.sparkSession.createDataFrame(notices, "family string, notice string").select("family", F.array_distinct(_pairs(_words(F.col("notice")))).alias("wanted"))
    # pairs as text, which Spark compares by hash: a paragraph may be a whole document
    pairs = named.select("digest", "family", F.array_distinct(_pairs(_words(F.col("paragraph")))).alias("own")).join(F.broadcast(templates), "family")
    shared = F.size(F.array_intersect("own", "wanted")) / F.greatest(F.least(F.size("own"), F.size("wanted")), F.lit(1))
    return pairs.groupBy("digest", "family").agg(F.max(shared).alias("s")).select(
        "digest", "family", F.round("s", 6).alias("similarity"), (F.col("s") >= CONFIRM).alias("confirmed")
    )


def _distinct_named(rows: DataFrame) -> DataFrame:
    """(digest, family, paragraph) of the named rows; copies meet in each task before the shuffle."""
    return rows.filter(F.col("family") != UNKNOWN).groupBy("digest", "family").agg(F.first("paragraph").alias("paragraph"))


def _with_comparison(rows: DataFrame, compared: DataFrame) -> DataFrame:
    """Rows with similarity and confirmed: 0 and false where no family is named."""
    return rows.join(compared, ["digest", "family"], "left").na.fill({"similarity": 0.0, "confirmed": False})


def classify(paragraphs: DataFrame, model: Model) -> DataFrame:
    """(paragraph, family, probability, similarity, confirmed) of distinct paragraphs."""
    rows = cut_lineage(paragraphs.select(F.monotonically_increasing_id().alias("row"), "paragraph", F.md5("paragraph").alias("digest")))
    judged = rows.join(judge(rows, model), "row")
    return _with_comparison(judged, compare(_distinct_named(judged))).select("paragraph", "family", "probability", "similarity", "confirmed")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, paragraph_no, paragraph, family, probability, similarity, confirmed) of all notices and of the lines with a cue word.

    Candidates are written once under a number and judged by it; their texts travel only to the numbers that give a row.
    """
    others = other_paragraphs(docs, text_col)
    model = fit(others)
    several = F.contains("paragraph", F.lit("\n"))
    found = cut_lineage(candidates(docs, decisive(model, others), id_col, text_col).select(
        F.monotonically_increasing_id().alias("row"), "*", several.alias("several"), (~several & F.lower("paragraph").rlike(_any_of(CUES))).alias("cue")
    ))
    judged = judge(found, model, "cue").filter((F.col("family") != UNKNOWN) | F.col("cue")).select("row", "family", "probability")
    rows = cut_lineage(found.drop("cue").join(cut_lineage(judged), "row").withColumn("digest", F.md5("paragraph")))
    compared = cut_lineage(compare(_distinct_named(rows)))
    # a paragraph that says no more than one of its lines
    whole = _distinct_named(rows.filter("several")).join(compared, ["digest", "family"])
    own = whole.select("family", "confirmed", F.col("digest").alias("whole"), F.explode(F.array_distinct(F.split("paragraph", "\n"))).alias("line"))
    own = own.select("family", "confirmed", "whole", F.md5("line").alias("digest"))
    lines = rows.filter("not several").select("digest", "family").distinct().join(compared, ["digest", "family"]).select("digest", "family", F.col("confirmed").alias("by_line"))
    said = own.join(lines, ["digest", "family"]).filter("by_line or not confirmed").select(F.col("whole").alias("digest")).distinct()
    kept = rows.join(cut_lineage(said.withColumn("said", F.lit(True))), "digest", "left").filter("said is null")
    return _with_comparison(kept, compared).select("doc_id", "paragraph_no", "paragraph", "family", "probability", "similarity", "confirmed")
