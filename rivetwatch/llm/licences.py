"""Licence scan: a trained n-gram classifier over paragraphs, confirmed by comparison with templates.

All work on the corpus is DataFrame functions.  Training rows are notices made from names and phrases of each licence
family (known), fixed sentences and notices with other names that only sound like licences, and a bounded sample of corpus paragraphs without any
phrase of the templates (unknown).  A multinomial logistic regression on the presence of word n-grams gives sparse
weights; a second, one-dimensional regression on rows that the first didn't see turns the margin over the unknown class
into a probability.  Only n-grams with at least one word that tells licences from other text are features: words of the
templates less those that are common in corpus lines without any phrase of a template; words of licences' names always
stay.  A paragraph without such a word can be nothing but unknown and is passed by at the price of a set look-up per word.
"""

from __future__ import annotations

from itertools import product
from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import stored

SAMPLE_DOCS, SAMPLE_PARAGRAPHS = 600, 4_000  # corpus paragraphs learned from as unknown, at most
RARE = 0.002  # share of sampled paragraphs up to which a word counts as rare
VOCABULARY = 8_192
THRESHOLD, COVERAGE = 0.5, 0.5
UNKNOWN = "unknown"

# Names of licence families as notices give them.
NAMES = {
    "agpl": ("the GNU Affero General Public License", "the GNU AGPL version 3", "AGPL-3.0", "the GNU Affero General Public License, version 3"),
    "apache": ("the Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0", "the Apache 2.0 license"),
    "bsd": ("the BSD License", "the 3-Clause BSD License", "BSD-3-Clause", "the 2-Clause BSD License", "a BSD-style license", "the New BSD License"),
    "cc-by": ("CC BY 4.0", "the Creative Commons Attribution 4.0 International License", "CC-BY-4.0", "CC BY 3.0"),
    "cc-by-nc": ("CC BY-NC 4.0", "the Creative Commons Attribution-NonCommercial 4.0 International License", "CC-BY-NC-4.0", "CC BY-NC-SA 4.0"),
    "cc-by-sa": ("CC BY-SA 4.0", "the Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA-4.0", "CC BY-SA 3.0"),
    "gpl": ("the GNU General Public License, version 3", "the GNU General Public License, version 2", "GPL-3.0", "the GNU GPL v3", "the GNU General Public License"),
    "lgpl": ("the GNU Lesser General Public License", "LGPL-2.1", "the GNU Lesser General Public License, version 3", "the GNU LGPL v3"),
    "mit": ("the MIT License", "MIT", "the MIT license", "an MIT-style license"),
    "mpl": ("the Mozilla Public License, Version 2.0", "MPL-2.0", "the Mozilla Public License", "MPL 2.0"),
    "public-domain": ("the public domain", "CC0 1.0", "CC0 1.0 Universal", "the Unlicense"),
}
# Well-known sentences of licences and of their notices.
SENTENCES = {
    "agpl": ("You should have received a copy of the GNU Affero General Public License along with this program.",
             "If you modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer network an opportunity to receive the Corresponding Source."),
    "apache": ("You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
               "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
            "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
            "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    "cc-by": ("You are free to share and adapt the material for any purpose, even commercially, as long as you give appropriate credit.",
              "To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/"),
    "cc-by-nc": ("You may not use the material for commercial purposes.", "To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/"),
    "cc-by-sa": ("If you remix, transform, or build upon the material, you must distribute your contributions under the same license as the original.",
                 "To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/"),
    "gpl": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
            "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
            "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    "lgpl": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
             "You should have received a copy of the GNU Lesser General Public License along with this library."),
    "mit": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",),
    "public-domain": ("This is free and unencumbered software released into the public domain.", "No rights reserved. The author has waived all copyright and related rights."),
}
FRAMES = ("{}", "{}.", "License: {}", "Licensed under {}.", "Released under {}.", "This work is licensed under {}.", "Distributed under {}", "This project is released under {}.",
          "This software is made available under the terms of {}.", "Published under {}", "The code is covered by {}", "Dedicated to {}.", "All files here are under {}.")
# Words by which names tell a family; they stay features however common they are.
KEPT = frozenset("affero agpl apache attribution bsd cc cc0 commons copyleft creative gpl lesser lgpl mit mozilla mpl noncommercial sharealike unlicense domain gnu".split())
# Sentences about licences and rights that name no family.
OTHERS = ("All rights reserved.", "Copyright by the author. All rights reserved.", "See the license file for details.", "A driving licence is required.", "The license fee is due every year.",
          "Used with permission of the publisher.", "This document is confidential and proprietary.", "Licensed to the city for public use.", "No part of this publication may be reproduced without written permission.",
          "The general public was invited.", "Software is provided by the vendor.", "The apache helicopter landed.", "A student at MIT wrote the version.", "They modified the program in the public interest.",
          "Subject to change without notice.", "This work was released last year.", "The warranty is limited to two years.", "Published under the name of the author.", "Terms and conditions apply.",
          "The source code was distributed under seal.", "A free copy of the software was given to any person.", "Version 2.0 was released.", "Version 3 of the documentation is free.")
# What the frames also stand before without naming a licence, so that names decide and not the frames.
OTHER_NAMES = ("pressure", "the new law", "the city council", "a different name", "review", "the terms of sale", "supervision", "the old rules", "drive", "a permit of the office", "number 1234", "the driver")


class Model(NamedTuple):
    families: list[str]  # the unknown class last
    rare: list[str]  # a paragraph without any of these words has no feature
    weights: dict[str, list[float]]  # n-gram -> weight per class
    intercepts: list[float]
    slope: float  # probability = sigmoid(slope * margin + offset)
    offset: float


def words_of(text):
    """Expression: lower-case words (letters and digits of ASCII) of a text."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " "), lambda w: w != "")


def ngrams(words, width: int):
    """Expression: runs of ``width`` words."""
    out = words
    for k in range(1, width):
        out = F.zip_with(out, F.when(F.size(words) > k, F.slice(words, k + 1, F.size(words))).otherwise(F.array().cast("array<string>")), lambda a, b: F.concat_ws(" ", a, b))
        out = F.slice(out, 1, F.greatest(F.size(words) - k, F.lit(0)))
    return out


def terms_of(words, rare: list[str]):
    """Expression: distinct one- to three-word n-grams that hold a rare word."""
    every = F.concat(words, ngrams(words, 2), ngrams(words, 3))
    return F.array_distinct(F.filter(every, lambda t: F.exists(F.split(t, " "), lambda w: w.isin(rare))))


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, paragraph (number of the line in its text), words: every line with a word."""
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("paragraph", "line"))
    return lines.select("doc_id", "paragraph", words_of(F.col("line")).alias("words")).filter(F.size("words") > 0)


def notices() -> list[tuple[str, str]]:
    """(family, text) of all known training rows."""
    return sorted({(fam, f.format(n)) for fam, names in NAMES.items() for f, n in product(FRAMES, names)} | {(fam, s) for fam, own in SENTENCES.items() for s in own})


def _pieces(spark: SparkSession) -> DataFrame:
    """Known training rows (family, words): notices whole, and sentences in runs of eight words as well."""
    whole = spark.createDataFrame(notices(), "family string, line string").select("family", words_of(F.col("line")).alias("words"))
    runs = whole.filter(F.size("words") > 12).select("family", F.explode(F.sequence(F.lit(1), F.size("words") - 7, F.lit(3))).alias("i"), "words")
    return whole.union(runs.select("family", F.slice("words", F.col("i"), 8).alias("words")))


def learn(docs: DataFrame) -> Model:
    """Train on the templates and on at most SAMPLE_PARAGRAPHS paragraphs of SAMPLE_DOCS documents chosen by a hash."""
    spark = docs.sparkSession
    known = _pieces(spark)
    phrases = known.select(F.explode(_short_runs(F.col("words"))).alias("t")).distinct()
    template_words = sorted(r[0] for r in known.select(F.explode("words")).distinct().collect())  # of the fixed values
    # Documents are chosen by id alone; their texts are fetched then.
    ids = [r[0] for r in docs.select("doc_id").filter("doc_id is not null").distinct().orderBy(F.xxhash64(F.col("doc_id").cast("long"), F.lit(1)), "doc_id").limit(SAMPLE_DOCS).collect()]
    sample = paragraphs(docs.select("doc_id", "text").filter(F.col("doc_id").isin(ids))) if ids else paragraphs(docs.select("doc_id", "text").limit(0))
    sample = sample.withColumn("words", F.slice("words", 1, 400)).orderBy(F.xxhash64("doc_id", "paragraph", "words")).limit(SAMPLE_PARAGRAPHS)
    sample = stored(sample.withColumn("row", F.xxhash64("doc_id", "paragraph", "words")), "licence-sample")
    like = sample.select("row", F.explode(_short_runs(F.col("words"))).alias("t")).join(F.broadcast(phrases), "t").select("row").distinct()
    unknown = sample.join(F.broadcast(like), "row", "left_anti").select(F.lit(UNKNOWN).alias("family"), "words")
    # Only lines that hold no phrase of a licence say which words are common, however many notices there are.
    n = max(1, unknown.count())
    often = unknown.select(F.explode(F.array_distinct(F.filter("words", lambda w: w.isin(template_words)))).alias("w")).groupBy("w").count()
    common = {r[0] for r in often.filter(F.col("count") > RARE * n + 1).collect() if r[0] not in KEPT and not r[0].startswith("licen")}
    # Words of the smallest kind carry no licence by themselves, whatever the corpus' language.
    small = {w for w in template_words if len(w) < 3 and not w.startswith("cc")} | {"the", "and", "this", "any", "you", "may", "not", "for", "that", "with", "are", "its"}
    rare = [w for w in template_words if w not in common and w not in small]

    others = spark.createDataFrame([(UNKNOWN, o) for o in [*OTHERS, *(f.format(n) for f, n in product(FRAMES, OTHER_NAMES))]], "family string, line string").select("family", words_of(F.col("line")).alias("words"))
    rows = known.union(others).union(unknown).withColumn("terms", terms_of(F.col("words"), rare))
    families = [*sorted(NAMES), UNKNOWN]
    label = F.array_position(F.array(*map(F.lit, families)), F.col("family")).cast("double") - 1
    rows = rows.select("terms", label.alias("label"), F.pmod(F.xxhash64("words"), F.lit(4)).alias("part"))
    rows = stored(rows.union(rows.sparkSession.createDataFrame([([], float(len(families) - 1), 0)], rows.schema)), "licence-rows")
    counted = CountVectorizer(inputCol="terms", outputCol="features", vocabSize=VOCABULARY, binary=True).fit(rows)
    rows = counted.transform(rows).coalesce(2).cache()  # a few thousand rows, read again in each iteration
    fitter = LogisticRegression(family="multinomial", maxIter=60, regParam=2e-3, elasticNetParam=0.3, standardization=False)
    # The margin of rows that a model hasn't seen, for calibration; the model itself takes all rows.
    part = fitter.fit(rows.filter("part != 0"))
    margins = part.transform(rows.filter("part = 0")).select((F.col("label") < len(families) - 1).cast("double").alias("label"), _margin(len(families)).alias("m"))
    calibrated = LogisticRegression(maxIter=50, regParam=1e-3).fit(margins.select("label", array_to_vector(F.array("m")).alias("features")))
    whole = fitter.fit(rows)
    rows.unpersist()
    weights = {}
    matrix = whole.coefficientMatrix.toArray()
    for j, term in enumerate(counted.vocabulary):
        own = [float(x) for x in matrix[:, j]]
        if any(abs(x) > 1e-9 for x in own):
            weights[term] = own
    slope = max(float(calibrated.coefficients[0]), 0.1)
    return Model(families, rare, weights, [float(x) for x in whole.interceptVector], slope, float(calibrated.intercept))


def _margin(classes: int):
    """Expression over a fitted model's raw prediction: best known class less the unknown one."""
    raw = vector_to_array(F.col("rawPrediction"))
    return F.array_max(F.slice(raw, 1, classes - 1)) - F.element_at(raw, classes)


def scan(docs: DataFrame, model: Model | None = None, threshold: float = THRESHOLD, coverage: float = COVERAGE) -> DataFrame:
    """One row per paragraph (line) with a licence word: doc_id, paragraph, family, probability, coverage, confirmed.

    ``family`` is ``unknown`` where the calibrated probability of any known family is below ``threshold``.
    ``coverage`` is the share of the paragraph's three-word runs that the nearest template of the family holds (of all
    its words, where it has fewer), or the share of the template's that it holds, if that is larger; ``confirmed`` says
    whether a known family reaches ``coverage``.  Null and empty texts have no paragraphs.  Rows alike in doc_id, place
    and words are reported once; no rows give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    model = model or learn(docs)
    found = paragraphs(docs.select("doc_id", "text")).filter(F.exists("words", lambda w: w.isin(model.rare)))
    found = found.withColumn("row", F.xxhash64("doc_id", "paragraph", "words"))
    found = stored(found, "licence-lines")  # the few lines with a licence word
    k = len(model.families)
    # The weights are bounded by the vocabulary.
    table = spark.createDataFrame([(t, w) for t, w in model.weights.items()] or [("", [0.0] * k)], "t string, w array<double>")
    key = ["doc_id", "paragraph", "row"]
    hits = found.select(*key, F.explode(terms_of(F.col("words"), model.rare)).alias("t")).distinct().join(F.broadcast(table), "t")
    sums = hits.groupBy("row").agg(*[F.sum(F.col("w")[i]).alias(f"s{i}") for i in range(k)])
    lines = found.dropDuplicates(key)
    scored = lines.join(sums, "row", "left")
    value = [F.coalesce(F.col(f"s{i}"), F.lit(0.0)) + model.intercepts[i] for i in range(k)]
    best = F.array_max(F.array(*[F.struct(v.alias("v"), F.lit(-i).alias("i")) for i, v in enumerate(value[:-1])]))
    scored = scored.select(*key, "words", best.alias("b"), value[-1].alias("u"))
    p = 1 / (1 + F.exp(-(F.lit(model.slope) * (F.col("b.v") - F.col("u")) + model.offset)))
    guess = F.element_at(F.array(*map(F.lit, model.families)), 1 - F.col("b.i"))
    scored = scored.select(*key, "words", guess.alias("guess"), p.alias("probability"))

    templates = spark.createDataFrame([(i, fam, line) for i, (fam, line) in enumerate(notices())], "template int, guess string, line string")
    templates = templates.select("template", "guess", _short_runs(words_of(F.col("line"))).alias("runs"))
    templates = templates.select("template", "guess", F.size("runs").alias("size"), F.explode("runs").alias("t"))
    own = scored.select("row", "guess", _short_runs(F.col("words")).alias("runs")).select("row", "guess", F.size("runs").alias("own"), F.explode("runs").alias("t"))
    near = own.join(F.broadcast(templates), ["guess", "t"]).groupBy("row", "template").agg((F.count(F.lit(1)) / F.least(F.first("own"), F.first("size"))).alias("c"))
    near = near.groupBy("row").agg(F.max("c").alias("c"))
    out = scored.join(near, "row", "left")
    known = F.col("probability") >= threshold
    share = F.when(known, F.coalesce("c", F.lit(0.0))).otherwise(0.0)
    return out.select("doc_id", "paragraph", F.when(known, F.col("guess")).otherwise(F.lit(UNKNOWN)).alias("family"), "probability", share.alias("coverage"), (known & (share >= coverage)).alias("confirmed"))


def _short_runs(words):
    """Expression: distinct three-word runs, or the whole line where it has fewer words."""
    return F.when(F.size(words) >= 3, F.array_distinct(ngrams(words, 3))).otherwise(F.array(F.concat_ws(" ", words)))
