from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from rivetwatch.llm.toxicity import FEATURES, _Flags, boost, features, isotonic, labelled, toxicity


def test_features_see_the_whole_text():
    flags = _Flags({"moron": 3.0, "lowei*": 2.0})
    x = dict(zip(FEATURES, features("fine " * 5000 + "you MORON!! loweitum m0r0n", flags)))
    assert round(np.expm1(x["hits"])) == 2 and x["densest"] == 2 and x["near_second"] == 2 and x["unmasked_hits"] == 1
    assert x["caps_words"] > 0 and x["exclaims"] > 0 and x["repeats"] > 0
    assert features("", flags) == [0.0] * len(FEATURES)


def test_isotonic_against_definition():
    rng = np.random.default_rng(4)
    raw, y = rng.normal(size=300), None
    y = (rng.random(300) < 1 / (1 + np.exp(-3 * raw))).astype(float)
    centres, rates = isotonic(raw, y)
    assert (np.diff(rates) > 0).all() and (np.diff(centres) > 0).all()
    order = np.argsort(raw)
    ys = y[order]
    # the fit at each place is the largest least mean over intervals around it
    best = [max(min(ys[a : b + 1].mean() for b in range(i, 300)) for a in range(i + 1)) for i in range(0, 300, 37)]
    assert np.allclose(sorted(set(np.round(best, 9)) - set(np.round(rates, 9))), [])


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(3)
    x = rng.random((3000, len(FEATURES)))
    y = ((x[:, 2] > 0.5) ^ (x[:, 5] > 0.3)).astype(float)
    t = boost(x[:2000], y[:2000])
    assert ((t.raw(x[2000:]) > 0) == (y[2000:] > 0)).mean() > 0.95


def test_held_out_rows_are_told_apart(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = toxicity(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id").filter("held_out").toPandas()
    assert len(got) > 500 and got.score.between(0, 1).all()
    wrong = got[got.predicted != got.toxic]
    assert len(wrong) / len(got) < 0.01
    assert ((got.score >= 0.5).astype(int) == got.predicted).all()


def test_odd_rows_and_missing_labels(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "idiot " * 30_000), (3, "fine words")], "doc_id long, text string").withColumn("score", F.lit(1))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in toxicity(docs, none).collect()] == [0.0] * 5
    some = spark.createDataFrame([(i, 1, None if i == 1 else 1) for i in (1, 2, 3, 3)], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity(docs, some).collect()} <= {0.0, 1.0}
    assert toxicity(docs.limit(0), none).count() == 0


def test_sample_is_bounded_and_leaves_the_test_fold_out(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 2).cast("int").alias("toxic"))
    got = labelled(docs, labels, 5, 0, rows=500)
    assert got.count() == 500 and got.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).count() == 0


def test_masked_words_in_time_that_grows_with_the_text():
    import re
    import time

    from rivetwatch.llm import toxicity as t

    plain = re.compile(r"[^\W\d_]+(?:[0-9@$!|*]+[^\W\d_]+)+|[@$][^\W\d_]+")
    rng = __import__("random").Random(4)
    for _ in range(4000):
        text = "".join(rng.choices("ab1@$*! é_.", k=rng.randrange(0, 25)))
        assert t._MASKED.findall(text) == plain.findall(text)
    for text in ("a" * 1_000_000 + " 1", "中" * 1_000_000 + "1", "A" * 1_000_000 + "1a", "a1" * 500_000, "$" * 1_000_000 + "a", "a" + "1" * 1_000_000):
        start = time.perf_counter()
        t.features(text, t._Flags({}))
        assert time.perf_counter() - start < 5
