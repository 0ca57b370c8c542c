"""Licence scan with a trained paragraph classifier (operator 8, native expressions only).

A paragraph is the text between blank lines.  Its lines are joined, as notices are wrapped, but for a line that ends
short and is followed by a new start.  It is judged by its sentences, of any length, whose features are their words and word pairs, but for those of function words
only.  A sparse (L1) multinomial logistic regression is fitted on the texts below with Spark ML; its classes are the
licence families, "unknown" (licence language of no listed family) and "none" (other text).
A temperature fitted on the left-out part of the texts calibrates its probabilities.

Scanning needs no shuffle: the features that have a weight are a few hundred (bounded by the texts
below), and all else adds nothing, so a sentence without a word of those that speak for a licence is "none";
one pattern finds the others, and only these are taken apart.  Of a sentence, the class of the greatest probability is taken; a family must be at least ``CONFIDENT`` likely and
be confirmed by one of its templates, with ``CONFIRM`` of the word pairs of the shorter in common;
else the sentence is "unknown".  What the confirming templates explain is then left out, but for wording that many families share, and the rest is
judged again, until it has no other family: a sentence can name several.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col

WORD = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
CONFIDENT, CONFIRM = 0.5, 0.6
PLAIN_LINES = 120        # training lines without any feature: what most text is to this classifier
NONE, UNKNOWN = "none", "unknown"
SHARED = 5               # wording that more families than this use says nothing about which one it is

# Wording of public licences and of the notices that name them.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.", "Licensed under the MIT license.", "This project is licensed under the MIT License.",
        "MIT License", "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.",
        "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software."],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.", "Apache License Version 2.0, January 2004", "Released under the Apache License 2.0.",
        "SPDX-License-Identifier: Apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "This work is licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an as is basis, without warranties or conditions of any kind, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License."],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License version 3.",
        "GNU General Public License Version 3, 29 June 2007", "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-or-later",
        "Released under the GNU General Public License, version 3 or later.", "Released under the GPL version 3.", "Licensed under the GPLv3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License version 2.",
        "GNU General Public License Version 2, June 1991", "SPDX-License-Identifier: GPL-2.0-only",
        "Released under the GNU General Public License, version 2 or later.", "Released under the GPL version 2.", "Licensed under the GPLv2.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version."],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License, version 2.1.", "This work is licensed under the GNU Lesser General Public License, version 3.",
        "Released under the LGPL.", "SPDX-License-Identifier: LGPL-2.1-or-later", "SPDX-License-Identifier: LGPL-3.0-only",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version."],
    "AGPL-3.0": [
        "Licensed under the GNU Affero General Public License, version 3.", "This work is licensed under the GNU Affero General Public License, version 3.",
        "Released under the AGPL version 3.", "SPDX-License-Identifier: AGPL-3.0-only",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "BSD": [
        "Released under the BSD License.", "Licensed under the BSD 3-Clause License.", "Licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed."],
    "MPL-2.0": [
        "Licensed under the Mozilla Public License, version 2.0.", "Released under the Mozilla Public License 2.0.", "SPDX-License-Identifier: MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "ISC": [
        "Released under the ISC License.", "Licensed under the ISC license.", "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
        "The software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness."],
    "Unlicense": [
        "Released under the Unlicense.", "SPDX-License-Identifier: Unlicense",
        "This is free and unencumbered software released into the public domain."],
    "CC0": [
        "Released under CC0 1.0.", "Licensed under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0", "Dedicated to the public domain under CC0."],
    "CC-BY": [
        "Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0.", "Released under CC BY 3.0.", "SPDX-License-Identifier: CC-BY-4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.", "This work is licensed under CC BY-SA 4.0.", "Released under CC BY-SA 3.0.", "SPDX-License-Identifier: CC-BY-SA-4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0.", "Released under CC BY-NC 3.0.", "SPDX-License-Identifier: CC-BY-NC-4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-ND": [
        "Licensed under CC BY-ND 4.0.", "This work is licensed under CC BY-ND 4.0.", "SPDX-License-Identifier: CC-BY-ND-4.0",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
}
OTHER = {
    UNKNOWN: [
        "Licensed under the terms of the vendor agreement.", "This software is licensed under a proprietary license.",
        "Released under a custom license.", "Use of this file is governed by the license that you accepted.", "See the license file for the terms.",
        "This work is licensed under the Example Public License.", "Licensed under the Academic Free License.", "Released under the Artistic License.", "You should have received a copy of the license along with this program.",
        "This program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose.",
        "The license forbids commercial use of the data.", "All rights reserved. No license is granted.",
        "Licensed under the European Union Public Licence.", "Released under the zlib License."],
    NONE: [
        "The committee met on Monday to talk about the new road.", "She was released from hospital after two days.",
        "This work is part of a larger study of the sea.", "The version that we saw was not the final one.", "The general was seen in public with his sons.",
        "He is free to go and may use the car.", "Under the old bridge the water was deep and cold.", "The film was released in June to mixed reviews.",
        "In this chapter we look at the history of the town.", "The source of the river is in the hills.", "A copy of the letter was found in the attic.",
        "The price of bread rose by three percent.", "Please call us on any day of the week.", "It was the best of times and it was the worst of times.",
        "He said that the public had a right to know.", "The house is to be sold with all that is in it.", "Version 3 of the plan was on the table by noon.",
        "This is a list of the birds that live in the park.", "The following day they went to the sea.", "You may not see it but it is there.",
        "The binary star was seen with the new telescope.", "The terms of the deal were not made known.", "The commons were open to all who lived near.",
        "A creative mind is at work here.", "The Apache people lived in the south west.", "He works at MIT and she works at the bank.",
        "Without warning the door was shut.", "The notice on the door said that the shop was closed.", "Subject to the weather we will leave at nine.",
        "The work of the artist is shown in the hall.", "Bread, milk, eggs, 2.0 kg of flour and 4.0 l of oil.", "By 4 o'clock the sun was low.",
        "The lesser of two evils is still an evil.", "The software was slow and the people were not happy.", "And the other one is of no use at all."],
}


FUNCTION_WORDS = frozenset(("the of and to in is this for or any by with be that you as are it from under may use a not all on at no "
                            "see he she we they his was were had will so but one two other o l").split())


def words_of(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def variants(text: str) -> list[str]:
    """A text, and its first and last two thirds if these have at least four words."""
    w = text.split()
    n = -(-2 * len(w) // 3)
    return [text, *([" ".join(w[:n]), " ".join(w[-n:])] if n >= 4 and n < len(w) else [])]


def grams(words: Column) -> Column:
    """The distinct words and word pairs of an array of words."""
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.concat(words, F.filter(pairs, lambda p: p.isNotNull())))


@dataclass
class Model:
    """Classes, their intercepts, the weights of the features that have any, and the temperature."""

    classes: list[str]
    bias: list[float]
    weights: dict[str, list[float]]
    temperature: float


def train(spark: SparkSession, strength: float = 0.0005, rounds: int = 60) -> Model:
    """Fit and calibrate the classifier on the texts of this module (a fixed, small set)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizerModel

    classes = sorted(TEMPLATES) + [UNKNOWN, NONE]
    rows = [(float(classes.index(c)), v, i % 5 == 4) for c, texts in (TEMPLATES | OTHER).items()
            for i, t in enumerate(texts) for v in variants(t)]
    rows += [(float(classes.index(NONE)), "and so on", i % 5 == 4) for i in range(PLAIN_LINES)]
    data = spark.createDataFrame(rows, "label double, text string, tested boolean").coalesce(1) \
        .withColumn("words", grams(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)))).cache()
    vocabulary = sorted({g for _, t, _ in rows for w in [words_of(t)] for g in [*w, *map(" ".join, zip(w, w[1:], strict=False))]
                         if not FUNCTION_WORDS.issuperset(g.split())})
    vectors = CountVectorizerModel.from_vocabulary(vocabulary, "words", "features", binary=True)
    lr = LogisticRegression(family="multinomial", elasticNetParam=1.0, regParam=strength, maxIter=rounds, standardization=True)
    # the temperature: of the left-out texts' log-odds, by a model that has not seen them
    part = lr.fit(vectors.transform(data.where("not tested"))).transform(vectors.transform(data.where("tested")))
    held = [(r["rawPrediction"].toArray(), int(r["label"])) for r in part.select("rawPrediction", "label").collect()]
    temperature = min((0.5, 0.75, 1.0, 1.25, 1.5, 2.0, 3.0), key=lambda t: _loss(held, t))
    fitted = lr.fit(vectors.transform(data))
    data.unpersist()
    matrix = fitted.coefficientMatrix.toArray()
    weights = {w: [float(x) for x in matrix[:, j]] for j, w in enumerate(vectors.vocabulary) if abs(matrix[:, j]).max() > 1e-6}
    bias = [float(x) for x in fitted.interceptVector.toArray()]
    if max(bias) != bias[-1]:
        raise ValueError("text without any feature must be of the class none")
    return Model(classes, bias, weights, temperature)


def _loss(held, temperature: float) -> float:
    """Mean negative log-likelihood of raw scores divided by a temperature."""
    from math import exp, log
    total = 0.0
    for raw, y in held:
        z = [x / temperature for x in raw]
        total += max(z) + log(sum(exp(x - max(z)) for x in z)) - z[y]
    return total / max(len(held), 1)


def _any_word(words) -> str:
    """A pattern for one of these words, by their first letters."""
    by_letter = {c: sorted(w[1:] for w in words if w[0] == c) for c in sorted({w[0] for w in words})}
    return "(?:" + "|".join(f"{c}(?:{'|'.join(map(re.escape, rest))})" for c, rest in by_letter.items()) + ")(?![a-z0-9])"


def sentences(block: Column) -> Column:
    """The sentences of a paragraph.  Its lines are joined unless one ends before the longest line's width and the next has a new start."""
    lines = F.transform(F.split(block, r"\r?\n"), lambda x: F.regexp_replace(x, r"^[\s#*/;%>|-]+|\s+$", ""))

    def ended(x, after, width):
        fits = F.length(x) + 1 + F.length(F.regexp_extract(after, r"^\S*", 0)) <= width
        return F.when(after.isNull(), x).when(fits & after.rlike(r"^[\"'(\[]?[\p{Lu}0-9]"), F.concat(x, F.lit("\n"))) \
            .otherwise(F.concat(x, F.lit(" ")))

    # arrays of one bind a value, which is else worked out again for each line
    bound = F.transform(F.array(F.struct(lines.alias("lines"))), lambda b: F.struct(
        b["lines"].alias("lines"), F.array_max(F.transform(b["lines"], F.length)).alias("width")))
    joined = F.transform(bound, lambda b: F.array_join(F.transform(b["lines"], lambda x, i: ended(
        x, F.get(b["lines"], i + 1), b["width"])), ""))[0]
    return F.split(joined, r"\n|(?<=[.!?][\"')]?)[ \t]+(?=[\"'(\[]?\p{Lu})")


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_paragraphs, and ``found``, the families of the paragraphs with licence language.

    ``found`` has structs (paragraph, family, probability, similarity), in the order of the text, one for each family of
    a paragraph; ``family`` is "unknown" where a sentence has licence language but no family is confident and confirmed.
    Null and empty texts have no paragraphs; null ids
    and repeated rows are passed through; an empty table gives an empty result; other columns are ignored.
    """
    def constant(value, kind):
        return F.from_json(F.lit(json.dumps(value)), kind)

    known = constant(sorted(model.weights), "array<string>")
    table = constant(model.weights, "map<string,array<double>>")
    bias = constant(model.bias, "array<double>")
    names = constant(model.classes, "array<string>")
    texts = [(c, w, {f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})
             for c, some in sorted(TEMPLATES.items()) for t in some if (w := words_of(t))]
    users: dict[str, set[str]] = {}
    for c, w, two in texts:
        for g in two.union(w):
            users.setdefault(g, set()).add(c)
    shared = {g for g, c in users.items() if len(c) > SHARED}
    templates = constant([{"family": c, "pairs": sorted(two), "own": sorted(two.union(w) - shared)} for c, w, two in texts],
                         "array<struct<family:string,pairs:array<string>,own:array<string>>>")
    # a feature that speaks for "none" at least as much as for any other class cannot change the outcome
    telling = r"(?<![a-z0-9])" + _any_word({w for g, x in model.weights.items() if max(x[:-1]) > x[-1] for w in g.split()} - FUNCTION_WORDS)

    # only sentences with a word of a weighted feature go on
    text = F.coalesce(col(text_col), F.lit(""))
    blocks = F.filter(F.split(text, r"\r?\n(?:[ \t\r\f]*+\n)+"), lambda x: F.length(F.trim(F.translate(x, "\r\n\t", "   "))) > 0)
    rows = docs.select(col(id_col).alias("doc_id"), blocks.alias("blocks"))

    def telling_pieces(x):
        return F.filter(F.transform(sentences(x), F.lower), lambda u: F.rlike(u, F.lit(telling)))

    some = F.filter(F.transform("blocks", lambda x, i: F.when(F.rlike(F.lower(x), F.lit(telling)), F.struct(
        i.cast("long").alias("paragraph"), telling_pieces(x).alias("pieces")))), lambda p: p.isNotNull())
    rows = rows.select("doc_id", F.size("blocks").cast("long").alias("n_paragraphs"), some.alias("some"))
    rows = rows.withColumn("some", F.transform("some", lambda p: F.struct(p["paragraph"].alias("paragraph"), F.transform(
        p["pieces"], lambda u: grams(F.regexp_extract_all(u, F.lit(WORD), F.lit(0)))).alias("pieces"))))

    def likely(g):
        z = F.aggregate(F.array_intersect(g, known), bias, lambda acc, w: F.zip_with(
            acc, F.try_element_at(table, w), lambda a, b: a + b))
        return F.transform(F.array(z), lambda z: F.transform(z, lambda x: F.exp((x - F.array_max(z)) / F.lit(model.temperature))))[0]

    def rated(g, size):
        """Of what is left of a piece: the likeliest class, all classes' weights, and the family's confirming templates."""
        first = F.transform(F.array(likely(g)), lambda e: F.struct(e.alias("e"), F.element_at(
            names, F.array_position(e, F.array_max(e)).cast("int")).alias("family")))
        shares = F.transform(first, lambda r: F.struct(r["e"].alias("e"), r["family"].alias("family"), F.transform(
            F.filter(templates, lambda t: t["family"] == r["family"]), lambda t: F.struct(
                (F.size(F.array_intersect(g, t["pairs"])).cast("double") / F.greatest(F.least(size, F.size(t["pairs"])), F.lit(1)))
                .alias("share"), t["own"].alias("own"))).alias("by")))
        return F.transform(shares, lambda r: F.struct(
            r["e"].alias("e"), r["family"].alias("family"),
            F.coalesce(F.array_max(F.transform(r["by"], lambda t: t["share"])), F.lit(0.0)).alias("similarity"),
            F.flatten(F.transform(F.filter(r["by"], lambda t: t["share"] >= CONFIRM), lambda t: t["own"])).alias("own")))

    kind = "array<struct<e:array<double>,family:string,similarity:double>>"

    def chain(g):
        """The classes of a piece, each of what those before it leave."""
        size = F.size(F.filter(g, lambda x: F.contains(x, F.lit(" "))))

        def step(acc, _):
            more = F.transform(rated(acc["left"], acc["size"]), lambda r: F.struct(
                F.when(r["similarity"] >= CONFIRM, F.array_except(acc["left"], r["own"])).alias("left"),
                # the rest counts only if it confirms another family
                F.when((r["family"] != NONE) & ((F.size(acc["out"]) == 0) | (r["similarity"] >= CONFIRM)) & ~F.exists(
                    acc["out"], lambda o: o["family"] == r["family"]), F.concat(acc["out"], F.array(F.struct(
                        r["e"].alias("e"), r["family"].alias("family"), r["similarity"].alias("similarity"))).cast(kind)))
                .alias("out")))
            return F.when(acc["left"].isNull(), acc).otherwise(F.transform(more, lambda m: F.struct(
                F.when(m["out"].isNotNull(), m["left"]).alias("left"), acc["size"].alias("size"),
                F.coalesce(m["out"], acc["out"]).alias("out")))[0])

        return F.aggregate(F.sequence(F.lit(1), F.lit(len(TEMPLATES))), F.struct(
            g.alias("left"), size.alias("size"), F.array().cast(kind).alias("out")), step)["out"]

    def judged(out):
        """Probabilities are against the classes that are not found for a reason of their own."""
        return F.transform(out, lambda o: F.transform(F.array(F.element_at(o["e"], F.array_position(names, o["family"]).cast("int")) / F.aggregate(
            F.filter(F.arrays_zip(names.alias("name"), o["e"].alias("e")), lambda c: (c["name"] == o["family"]) | ~F.exists(
                out, lambda x: x["family"] == c["name"])), F.lit(0.0), lambda a, c: a + c["e"])), lambda p: F.struct(
                    F.when((p >= CONFIDENT) & (o["similarity"] >= CONFIRM), o["family"]).otherwise(F.lit(UNKNOWN)).alias("family"),
                    p.alias("probability"), o["similarity"].alias("similarity")))[0])

    def merged(p):
        return F.transform(F.array_distinct(F.transform(p["all"], lambda x: x["family"])), lambda f: F.transform(
            F.array(F.filter(p["all"], lambda x: x["family"] == f)), lambda same: F.struct(
                p["paragraph"].alias("paragraph"), f.alias("family"),
                F.array_max(F.transform(same, lambda x: x["probability"])).alias("probability"),
                F.array_max(F.transform(same, lambda x: x["similarity"])).alias("similarity")))[0])

    found = F.transform("some", lambda p: F.struct(p["paragraph"].alias("paragraph"), F.transform(p["pieces"], chain).alias("chains")))
    found = F.transform(found, lambda p: F.struct(p["paragraph"].alias("paragraph"), F.flatten(F.transform(p["chains"], judged)).alias("all")))
    return rows.select("doc_id", "n_paragraphs", F.flatten(F.transform(found, merged)).alias("found"))


def summary(scanned: DataFrame) -> DataFrame:
    """Per row of ``scan``: doc_id, n_paragraphs, n_licence, families (sorted, joined by a comma), paragraphs, probability."""
    return scanned.select(
        "doc_id", "n_paragraphs", F.size(F.array_distinct(F.transform("found", lambda p: p["paragraph"]))).cast("long").alias("n_licence"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda p: p["family"]))), ",").alias("families"),
        F.array_join(F.array_distinct(F.transform("found", lambda p: p["paragraph"].cast("string"))), ",").alias("paragraphs"),
        F.array_max(F.transform("found", lambda p: p["probability"])).alias("probability"))
