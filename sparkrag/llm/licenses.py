"""Licence scan with DataFrame functions only: a trained paragraph classifier, confirmed by templates.

``fit`` trains a multinomial logistic regression with an elastic-net penalty on sparse word 1- and 2-grams: notices of
each licence family (what ``NAMES`` are called in ``CARRIERS``, identifiers, and sentences of ``GRANTS``; whole, cut, and
after a copyright line), against paragraphs of the corpus (at most ``most_plain``, those with the smallest hash) and
hand-written near misses. Corpus paragraphs that mention licences are examples like others, unless they cover a template,
and so are notices themselves. Words that ordinary paragraphs use often are no features. A quarter of the notices and of
the plain paragraphs is held back, so that no form of them is seen in training. On these the probabilities are calibrated
(a temperature, and an offset for the class "unknown", that give them the least log loss), and the least probability is set
at which a family may be named (``floor``): at most 1 % of held-out plain paragraphs reach it. Then the weights are fitted
again to all examples.

``scan`` splits texts into paragraphs (lines) and looks in each for feature words, in one pass without a shuffle.
A paragraph without any has the same, "unknown", prediction as the empty one, so only the others (a few in a thousand)
go on to be scored by a join with the weights. A named family counts once its words also cover a template of the family,
in order: at least ``COVER`` of the template's runs of three words; others are reported as unconfirmed.

Notices are often wrapped, so that no line of them covers enough of a template. So neighbouring lines are scored as one
text, too: windows of two lines or more around feature words, without a line that has no words inside, with fewer words
between the first and the last line than the longest template has; of these two lines only as many words as the
template count. A window is named and confirmed as a line is. It counts where no line of it is confirmed for the same
family, windows of a family that overlap count once, and lines of a counted window are not reported as unconfirmed.

Fixed results: null and empty texts have no paragraph; rows that repeat a doc_id are scanned each; ties between
families go to the first by name; an empty table stays empty, and the classifier then learns from the notices and the
near misses alone; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from math import exp, log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

# Names, identifiers and sentences of public licences.
NAMES: dict[str, list[str]] = {
    "agpl": ["GNU Affero General Public License", "GNU AGPL v3"],
    "apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license"],
    "bsd": ["BSD 3-Clause License", "BSD 2-Clause License", "BSD License", "New BSD license"],
    "cc-by": ["Creative Commons Attribution 4.0 International License", "CC BY 4.0", "Creative Commons Attribution License"],
    "cc-by-nc": ["Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0", "CC BY-NC-SA 4.0"],
    "cc-by-sa": ["Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike License"],
    "cc0": ["CC0 1.0 Universal Public Domain Dedication", "Creative Commons Zero license"],
    "epl-2.0": ["Eclipse Public License 2.0", "Eclipse Public License v. 2.0"],
    "gpl": ["GNU General Public License, version 3", "GNU General Public License", "GNU GPL v3", "GPLv2"],
    "isc": ["ISC License", "ISC licence"],
    "lgpl": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License", "GNU LGPL v3"],
    "mit": ["MIT License", "MIT license", "Expat License"],
    "mpl-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0"],
    "unlicense": ["Unlicense", "terms of the Unlicense"],
}
IDENTIFIERS: dict[str, list[str]] = {
    "agpl": ["AGPL-3.0-only", "AGPL-3.0-or-later"],
    "apache-2.0": ["Apache-2.0"],
    "bsd": ["BSD-3-Clause", "BSD-2-Clause"],
    "cc-by": ["CC-BY-4.0"],
    "cc-by-nc": ["CC-BY-NC-4.0", "CC-BY-NC-SA-4.0"],
    "cc-by-sa": ["CC-BY-SA-4.0"],
    "cc0": ["CC0-1.0"],
    "epl-2.0": ["EPL-2.0"],
    "gpl": ["GPL-3.0-or-later", "GPL-2.0-only"],
    "isc": ["ISC"],
    "lgpl": ["LGPL-2.1-or-later", "LGPL-3.0-only"],
    "mit": ["MIT"],
    "mpl-2.0": ["MPL-2.0"],
    "unlicense": ["Unlicense"],
}
GRANTS: dict[str, list[str]] = {
    "agpl": ["under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "The ASF licenses this file to you under the Apache License, Version 2.0",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software",
    ],
    "cc-by": ["You are free to share and adapt the material for any purpose, even commercially, under the following terms: Attribution"],
    "cc-by-nc": ["You may not use the material for commercial purposes. Licensed under Creative Commons Attribution-NonCommercial"],
    "cc-by-sa": [
        "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
        "If you remix, transform, or build upon the material, you must distribute your contributions under the same license as the original.",
    ],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "epl-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "which accompanies this distribution, and is available at https://www.eclipse.org/legal/epl-2.0"],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        "This work is licensed under the GNU General Public License, version 3.",
    ],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU Lesser General Public License along with this library",
    ],
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright 2019 Example Corporation. All rights reserved.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.",
        "No part of this publication may be reproduced, distributed, or transmitted in any form without the prior written permission of the publisher.",
        "This document contains confidential and proprietary information of its owner and may not be disclosed without written consent.",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary",
    ],
}
CARRIERS = ["Licensed under the {}.", "Released under the {}.", "This project is licensed under the {}.", "This work is licensed under the {}.", "Distributed under the {}; see LICENSE for details.", "Made available under the {}.", "The code is covered by the {}.", "Text is available under the {}."]
NEAR_MISSES = [
    "He was driving without a license.",
    "The public library is free of charge to any person.",
    "A version of the software was released in the general public interest.",
    "The apache helicopter landed under cover.",
    "She studied at MIT and published her work.",
    "Without warranty the dealer would not sell the car.",
    "The foundation obtained permission to modify the building.",
    "Creative work of the commons committee was published.",
    "The license plate was obtained in compliance with the rules.",
    "International attribution of the painting is under dispute.",
    "The source of the Nile and its forms.",
    "Copyright law was discussed at the conference.",
    "He got his driving license under the Apache tribe version 2.0.",
    "All seats were reserved and all rights were read to him.",
    "The court debated whether a software license is a contract.",
    "The eclipse was visible to the general public for two minutes.",
    "She asked for permission to use the kitchen free of charge.",
    "A bachelor of science degree from the university is required.",
    "The domain of the function is public knowledge.",
    "The restaurant renewed its license, version after version of the form.",
    "Any person may obtain a copy of the timetable at the station.",
    "The material was distributed in binary form in the exhibition.",
    "The Mozilla browser and the Eclipse editor were compared in a public test.",
    "Fishing licenses are available at the harbour office.",
]
UNKNOWN = "unknown"
COVER = 0.6
RUN = 3  # words of a template that count as one when texts are compared with it


def _plain_words(text: str) -> list[str]:
    return "".join(x if x.isascii() and x.isalnum() else " " for x in text.lower()).split()


def notices() -> dict[str, list[str]]:
    """All notices of each family."""
    out = {f: list(xs) for f, xs in GRANTS.items()}
    for family, names in NAMES.items():
        # names of some licences have no article
        out[family] += [c.format(name).replace("the CC", "CC").replace("the GPLv2", "GPLv2") for name in names for c in CARRIERS]
        out[family] += [f"SPDX-License-Identifier: {x}" for x in IDENTIFIERS[family]]
    return dict(sorted(out.items()))


def templates() -> list[tuple[str, list[str]]]:
    """(family, words) of what a notice must cover: one carrier for each name, identifiers and grants."""
    out = [(f, _plain_words(x)) for f, xs in GRANTS.items() for x in xs]
    out += [(f, _plain_words(CARRIERS[0].format(name).replace("the CC", "CC").replace("the GPLv2", "GPLv2"))) for f, names in NAMES.items() for name in names]
    return out + [(f, _plain_words(f"SPDX-License-Identifier: {x}")) for f, xs in IDENTIFIERS.items() for x in xs]


LONGEST = max(len(w) for _, w in templates())
FREQUENT = 0.002  # share of plain paragraphs that a feature word may occur in


def line_words(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def ngrams(words: Column) -> Column:
    """Distinct words and pairs of neighbours."""

    def make(w: Column) -> Column:
        pairs = F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(" ", F.get(w, i - 1), F.get(w, i)))).otherwise(F.array().cast("array<string>"))
        return F.array_distinct(F.concat(w, pairs))

    return _once(words, make)


def runs(words: Column) -> Column:
    """Distinct runs of ``RUN`` words, or the whole of fewer."""

    def make(w: Column) -> Column:
        long_ = F.transform(F.sequence(F.lit(1), F.size(w) - (RUN - 1)), lambda i: F.concat_ws(" ", F.slice(w, i, RUN)))
        return F.array_distinct(F.when(F.size(w) >= RUN, long_).otherwise(F.array(F.concat_ws(" ", w))))

    return _once(words, make)


@dataclass(frozen=True)
class Classifier:
    families: list[str]
    weights: DataFrame  # gram string, w array<double>: at most a few thousand rows
    bias: list[float]
    vocabulary: list[str]  # the words of the grams
    temperature: float
    offset: float  # of the class "unknown"
    floor: float


def _variants(text: str) -> list[str]:
    w = text.split()
    cuts = {(0, len(w))} | ({(0, len(w) * 3 // 4), (len(w) // 4, len(w))} if len(w) > 12 else set())
    return [before + " ".join(w[a:b]) for a, b in sorted(cuts) for before in ("", "Copyright (c) 2020 The Authors. ")]


def _known(spark: SparkSession) -> DataFrame:
    """(guess, templates): the templates of each family as runs of words."""
    rows = spark.createDataFrame(templates(), "guess string, words array<string>").select("guess", runs(F.col("words")).alias("runs"))
    return rows.groupBy("guess").agg(F.collect_list("runs").alias("templates"))


def _once(x: Column, use) -> Column:
    """use(x) with x evaluated once, also inside functions over arrays: there a column would be computed for each element."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def _cover(templates_: Column, line: Column) -> Column:
    return _once(runs(line_words(line)), lambda own: F.array_max(F.transform(templates_, lambda t: F.size(F.array_intersect(t, own)) / F.size(t))))


def _examples(spark: SparkSession, docs: DataFrame, most_plain: int) -> DataFrame:
    """(family, line, part, plain): a notice and its variants are of one part; part 0 is held out."""
    rows = [(family, x, i % 4, False) for family, own in notices().items() for i, s in enumerate(own) for x in _variants(s)]
    rows += [(UNKNOWN, x, i % 4, False) for i, x in enumerate(NEAR_MISSES)]
    near = spark.createDataFrame(rows, "family string, line string, part int, plain boolean")
    chosen = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_plain // 4)
    lines = docs.join(F.broadcast(chosen.distinct()), "doc_id", "left_semi").select(F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line")).where("line <> ''").dropDuplicates(["line"])
    lines = lines.orderBy(F.xxhash64("line"), "line").limit(most_plain)
    every = _known(spark).agg(F.flatten(F.collect_list("templates")).alias("templates"))
    lines = lines.crossJoin(F.broadcast(every)).where(_cover(F.col("templates"), F.col("line")) < COVER)  # one row on the other side
    return near.unionByName(lines.select(F.lit(UNKNOWN).alias("family"), "line", F.pmod(F.xxhash64("line"), F.lit(4)).cast("int").alias("part"), F.lit(True).alias("plain")))


def _calibrate(rows: list[tuple[int, list[float]]]) -> tuple[float, float]:
    """(temperature, offset of class 0) that give the held-out rows (class, scores) the least log loss, each class counting alike."""
    share = {k: 1 / sum(c == k for c, _ in rows) for k in {c for c, _ in rows}}

    def loss(t: float, b: float) -> float:
        total = 0.0
        for k, z in rows:
            own = [(x + (b if i == 0 else 0)) / t for i, x in enumerate(z)]
            top = max(own)
            total += share[k] * (top + log(sum(exp(x - top) for x in own)) - own[k])
        return total

    best = (1.0, 0.0)
    for width in (4.0, 1.0, 0.25):  # a grid around the best point so far, then a finer one
        t0, b0 = best
        best = min(((t0 * 2 ** (i * width / 4), b0 + j * width / 2) for i in range(-3, 4) for j in range(-3, 4)), key=lambda x: loss(*x))
    return best


def _train(data: DataFrame, grams: list[str], families: list[str], words: list[str], penalty: float) -> Classifier:
    from pyspark.ml.classification import LogisticRegression

    spark = data.sparkSession
    model = LogisticRegression(family="multinomial", weightCol="weight", regParam=penalty, elasticNetParam=0.3, maxIter=60, standardization=False).fit(data.select("features", "label", "weight"))
    matrix = model.coefficientMatrix.toArray()
    pairs = [(g, [float(x) for x in matrix[:, i]]) for i, g in enumerate(grams) if abs(matrix[:, i]).max() > 1e-9]
    weights = spark.createDataFrame(pairs, "gram string, w array<double>")
    vocabulary = sorted({w for g, _ in pairs for w in g.split(" ")} & set(words))
    return Classifier(families, weights, [float(x) for x in model.interceptVector], vocabulary, 1.0, 0.0, 0.0)


def fit(docs: DataFrame, most_plain: int = 2_000, penalty: float = 1e-3, refit: bool = True) -> Classifier:
    """Train on three quarters of the examples and calibrate on the others; then, with ``refit``, train on all of them."""
    from pyspark.ml.feature import CountVectorizer

    spark = docs.sparkSession
    families = [UNKNOWN, *notices()]
    examples = _examples(spark, docs, most_plain).withColumn("w", line_words(F.col("line"))).withColumn("grams", ngrams(F.col("w")))
    rows = cut(spark, examples.coalesce(1), "examples")  # a few thousand rows: ``most_plain`` and the notices
    plain = rows.where("plain")
    n_plain = plain.count()
    # at most 1 / FREQUENT times the mean number of words of a paragraph
    often = {r.word for r in plain.select(F.explode(F.array_distinct("w")).alias("word")).groupBy("word").count().where(F.col("count") > max(1, FREQUENT * n_plain)).collect()}
    words = sorted({w for own in notices().values() for x in own for y in _variants(x) for w in _plain_words(y)} - often)
    keep = F.array(*map(F.lit, words))
    # a gram is a feature if one of its words is a feature word
    rows = rows.withColumn("grams", F.filter("grams", lambda g: F.arrays_overlap(F.split(g, " "), keep)))
    rows = rows.withColumn("label", F.array_position(F.array(*map(F.lit, families)), F.col("family")).cast("double") - 1)
    vector = CountVectorizer(inputCol="grams", outputCol="features", binary=True, vocabSize=1 << 13, minDF=1.0).fit(rows.where("family <> 'unknown'"))
    data = vector.transform(rows).withColumn("weight", F.when(F.col("family") == UNKNOWN, 1.0).otherwise(3.0))
    half = _train(data.where("part <> 0"), vector.vocabulary, families, words, penalty)
    held = cut(spark, rows.where("part = 0").select(F.monotonically_increasing_id().alias("row"), "family", "line", "plain", F.col("label").cast("int").alias("label")), "held")
    scores = _logits(held, half).select("label", "z").collect()  # about a quarter of the examples
    temperature, offset = _calibrate([(r.label, list(r.z)) for r in scores])
    half = replace(half, temperature=temperature, offset=offset)
    wrong = sorted((r.p for r in _scored(held.where("plain"), half).select("p").collect()), reverse=True)
    floor = max(0.5, wrong[len(wrong) // 100] + 1e-9 if wrong else 0.5)
    whole = _train(data, vector.vocabulary, families, words, penalty) if refit else half
    return replace(whole, temperature=temperature, offset=offset, floor=floor)


def _logits(lines: DataFrame, c: Classifier) -> DataFrame:
    """lines (row, ..., line) with the scores of all families as z."""
    grams = lines.select("row", F.explode(ngrams(line_words(F.col("line")))).alias("gram")).join(F.broadcast(c.weights), "gram")
    sums = grams.groupBy("row").agg(*(F.sum(F.col("w")[k]).alias(f"z{k}") for k in range(len(c.families))))
    z = F.array(*((F.coalesce(F.col(f"z{k}"), F.lit(0.0)) + c.bias[k] + (c.offset if k == 0 else 0.0)) / c.temperature for k in range(len(c.families))))
    return lines.join(sums, "row", "left").select(*lines.columns, z.alias("z"))


def _scored(lines: DataFrame, c: Classifier) -> DataFrame:
    """lines (row, ..., line) with best family other than unknown and its probability p."""
    powers = F.transform("z", lambda x: F.exp(x - F.array_max("z")))
    ranked = F.transform("powers", lambda x, k: F.struct(F.when(k > 0, x).alias("p"), (-k).alias("k")))
    scored = _logits(lines, c).withColumn("powers", powers)
    best = F.struct((F.array_max(ranked)["p"] / F.aggregate("powers", F.lit(0.0), lambda t, x: t + x)).alias("p"), F.array_max(ranked)["k"].alias("k"))
    named = F.array(*map(F.lit, c.families))
    return scored.withColumn("best", best).select(*lines.columns, F.get(named, -F.col("best.k")).alias("guess"), F.col("best.p").alias("p"))


def _near(lines: Column, at: Column, keep: Column) -> Column:
    """The lines around line ``at`` that a window can reach: number, words (of long lines, both ends) and whether a feature word is among them."""
    begin = F.greatest(at - LONGEST, F.lit(0))

    def entry(line: Column, i: Column) -> Column:
        w = line_words(line)
        ends = F.concat(F.slice(w, 1, LONGEST), F.slice(w, -LONGEST, LONGEST))
        return F.struct((begin + i).alias("at"), F.when(F.size(w) > 2 * LONGEST, ends).otherwise(w).alias("w"), F.arrays_overlap(w, keep).alias("f"))

    return F.transform(F.slice(lines, begin + 1, F.lit(2 * LONGEST + 1)), entry)


def _windows(lines: DataFrame, known: Column) -> DataFrame:
    """row (doc_row, first, last), line: windows of lines whose first feature line is the row's own and whose words cover a template."""
    near = F.col("near")
    own = F.array_position(F.transform(near, lambda x: x.at), F.col("at")).cast("int")
    rows = lines.select("doc_row", "at", "near").withColumn("own", own)
    starts = F.filter(F.sequence(F.lit(1), F.col("own")), lambda i: ~F.exists(F.slice(near, i, F.col("own") - i), lambda x: x.f | (F.size(x.w) == 0)))
    rows = rows.withColumn("i", F.explode(starts))
    least, i = F.greatest(F.col("i") + 1, F.col("own")), F.col("i")

    def inside(j: Column) -> Column:
        return F.slice(near, i + 1, j - i - 1)

    def fits(j: Column) -> Column:
        words = F.aggregate(inside(j), F.lit(0), lambda n, x: n + F.size(x.w))
        return (words < LONGEST) & ~F.exists(F.slice(near, i, j - i + 1), lambda x: F.size(x.w) == 0)

    ends = F.when(least <= F.size(near), F.filter(F.sequence(least, F.size(near)), fits)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("j", F.explode(ends))
    first, last = F.get(near, i - 1), F.get(near, F.col("j") - 1)
    tail = F.slice(first["w"], -F.least(F.size(first["w"]), F.lit(LONGEST)), F.lit(LONGEST))
    words = F.concat(tail, F.flatten(F.transform(inside(F.col("j")), lambda x: x.w)), F.slice(last["w"], 1, LONGEST))
    rows = rows.select(F.struct("doc_row", first["at"].alias("first"), last["at"].alias("last")).alias("row"), words.alias("w"))
    covered = _once(F.array_distinct("w"), lambda w: F.exists(known, lambda t: F.size(F.array_intersect(t, w)) >= COVER * F.size(t)))
    return rows.where(covered).select("row", F.concat_ws(" ", "w").alias("line"))


def _disjoint(spans: Column) -> Column:
    """Of the spans (last, first), in order of their ends, those that overlap none taken before: as many as can be."""
    none = F.array().cast("array<struct<last:int,first:int>>")
    return F.aggregate(F.array_sort(spans), none, lambda taken, x: F.when((F.size(taken) == 0) | (x["first"] > F.get(taken, F.size(taken) - 1)["last"]), F.concat(taken, F.array(x))).otherwise(taken))


def scan(docs: DataFrame, c: Classifier, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents: row, doc_id, n_paragraphs; paragraphs that are named a family: row, paragraph number, family, p, confirmed).

    A wrapped notice is one paragraph, with the number of its first line."""
    spark = docs.sparkSession
    keep = F.array(*map(F.lit, c.vocabulary))
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    numbered = F.transform(lines, lambda x, i: F.struct(i.alias("at"), x.alias("line")))
    found = F.filter(numbered, lambda s: F.arrays_overlap(line_words(s.line), keep))
    found = F.transform(found, lambda s: F.struct(s.at.alias("at"), s.line.alias("line"), _near(lines, s.at, keep).alias("near")))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.size(F.array_remove(lines, "")).cast("long").alias("n_paragraphs"), found.alias("found"))
    rows = cut(spark, rows, "paragraphs")
    lines_ = rows.where(F.size("found") > 0).select(F.col("row").alias("doc_row"), F.inline("found"))
    known = _known(spark)

    def named(texts: DataFrame) -> DataFrame:
        return _scored(texts, c).where(F.col("p") >= c.floor).join(F.broadcast(known), "guess").withColumn("confirmed", _cover(F.col("templates"), F.col("line")) >= COVER)

    single = named(lines_.select("doc_row", "at", "line").withColumn("row", F.struct("doc_row", "at")))
    single = cut(spark, single.select(F.col("doc_row").alias("row"), "at", F.col("guess").alias("family"), "p", "confirmed"), "named")
    wide = cut(spark, _windows(lines_, F.array(*(F.array(*map(F.lit, sorted(set(w)))) for _, w in templates()))), "windows")
    wide = named(wide).where("confirmed").select("row.doc_row", "row.first", "row.last", F.col("guess").alias("family"), "p")
    sure = single.where("confirmed").select(F.col("row").alias("doc_row"), "at", "family")
    wide = wide.join(sure, (wide["doc_row"] == sure["doc_row"]) & (wide["family"] == sure["family"]) & sure["at"].between(wide["first"], wide["last"]), "left_anti")
    per = wide.groupBy(F.col("doc_row").alias("row"), "family").agg(_disjoint(F.collect_set(F.struct("last", "first"))).alias("spans"), F.max("p").alias("p"))
    per = cut(spark, per, "wrapped")
    spans = per.select("row", F.inline("spans"))
    left = single.join(spans, (single["row"] == spans["row"]) & ~single["confirmed"] & single["at"].between(spans["first"], spans["last"]), "left_anti")
    whole = per.select("row", F.inline("spans"), "family", "p").select("row", F.col("first").alias("at"), "family", "p", F.lit(True).alias("confirmed"))
    return rows.drop("found"), left.unionByName(whole)


def op6_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    base, found = scan(docs, fit(docs))
    per = found.groupBy("row").agg(F.count_if("confirmed").alias("n_licensed"), F.count_if(~F.col("confirmed")).alias("n_unconfirmed"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family")))), ",").alias("families"))
    out = base.join(per, "row", "left")
    return out.select("doc_id", "n_paragraphs", F.coalesce("n_licensed", F.lit(0)).cast("long").alias("n_licensed"), F.coalesce("n_unconfirmed", F.lit(0)).cast("long").alias("n_unconfirmed"), F.coalesce("families", F.lit("")).alias("families"))
