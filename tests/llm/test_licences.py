from __future__ import annotations

import math
import re

import pytest
from pyspark.sql import functions as F

from rivetwatch.llm.licences import KEPT, NAMES, UNKNOWN, learn, notices, scan


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return learn(docs)


def grams(words, k):
    return [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]


def brute(doc_id, text, m):
    templates: dict = {}
    for fam, line in notices():
        w = [x for x in re.split("[^a-z0-9]+", line.lower()) if x]
        templates.setdefault(fam, []).append(set(grams(w, 3)) or {" ".join(w)})
    for i, line in enumerate((text or "").split("\n")):
        w = [x for x in re.split("[^a-z0-9]+", line.lower()) if x]
        if not set(w) & set(m.rare):
            continue
        terms = {t for k in (1, 2, 3) for t in grams(w, k) if set(t.split()) & set(m.rare)}
        raw = [b + sum(m.weights[t][j] for t in sorted(terms) if t in m.weights) for j, b in enumerate(m.intercepts)]
        best = max(range(len(raw) - 1), key=lambda j: raw[j])
        p = 1 / (1 + math.exp(-(m.slope * (raw[best] - raw[-1]) + m.offset)))
        fam = m.families[best] if p >= 0.5 else UNKNOWN
        own = set(grams(w, 3)) or {" ".join(w)}
        c = max((len(own & t) / min(len(own), len(t)) for t in templates.get(fam, [])), default=0.0)
        yield doc_id, i, fam, round(p, 6), round(c, 6), fam != UNKNOWN and c >= 0.5


def rows_of(df):
    return sorted((r.doc_id, r.paragraph, r.family, round(r.probability, 6), round(r.coverage, 6), r.confirmed) for r in df.collect())


def test_whole_table_against_brute_force(docs, model):
    got = rows_of(scan(docs, model))
    assert got == sorted(x for r in docs.collect() for x in brute(r.doc_id, r.text, model))
    assert {g[2] for g in got if g[5]} >= {"apache", "cc-by-nc", "gpl", "mit"}


def test_unseen_wordings_and_lookalikes(spark, model):
    known = {"Code is released under the Apache License 2.0, see below.": "apache", "This software may be used under the terms of the GNU General Public License version 2": "gpl",
             "You can redistribute it under the terms of the GNU Lesser General Public License.": "lgpl", "Text: CC BY-SA 4.0": "cc-by-sa", "It is licensed under the Mozilla Public License.": "mpl"}
    none = ["All rights reserved.", "the quick brown fox", "A license to drive", "The general public may visit the version on display"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*known, *none])], "doc_id long, text string")
    got = {r.doc_id: r for r in scan(df, model).collect()}
    assert [got[i].family for i in range(len(known))] == list(known.values())
    assert all(i + len(known) not in got or got[i + len(known)].family == UNKNOWN for i in range(len(none)))


def test_odd_rows(spark, model):
    line = "Released under the MIT License."
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, line), (4, line), (None, line), (5, ("filler words\n" * 20_000) + line), (6, "MIT")]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, family int")
    got = [(r.doc_id, r.paragraph, r.family, r.confirmed) for r in scan(df, model).collect()]
    # "mit" is a word of the corpus' languages as well, so alone it is looked at but names nothing.
    assert sorted(got, key=str) == sorted([(4, 0, "mit", True), (5, 20_000, "mit", True), (6, 0, UNKNOWN, False), (None, 0, "mit", True)], key=str)
    assert scan(df.limit(0), model).collect() == []


def test_no_python_on_the_main_path(docs, model):
    plan = scan(docs, model)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_empty_corpus_still_learns(spark):
    m = learn(spark.createDataFrame([], "doc_id long, text string"))
    assert m.weights and m.families[-1] == UNKNOWN


@pytest.mark.parametrize("every", [20, 2])
def test_notices_are_found_however_frequent(spark, docs, every):
    planted = {"License: MIT": "mit", "Licensed under MIT": "mit", "Released under the Apache License, Version 2.0.": "apache", "Licensed under GPL-3.0.": "gpl"}
    lines = list(planted)
    rows = [(r.doc_id, f"{r.text}\n{lines[i // every % 4]}" if i % every == 0 else r.text) for i, r in enumerate(docs.orderBy("doc_id").collect())]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = {(d, (t or "").count("\n"), planted[t.rsplit("\n", 1)[1]]) for i, (d, t) in enumerate(rows) if i % every == 0}
    got = {(r.doc_id, r.paragraph, r.family) for r in scan(df).filter(F.col("family") != UNKNOWN).collect()}
    assert want <= got


def test_every_name_holds_a_word_that_is_kept():
    for names in NAMES.values():
        for n in names:
            assert {w for w in re.split("[^a-z0-9]+", n.lower()) if w in KEPT or w.startswith("licen")}, n
