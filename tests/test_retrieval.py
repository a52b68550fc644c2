from __future__ import annotations

import math
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rivetwatch.operators import retrieval, stats


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.createDataFrame([(1, "pump seal leak on pump two"), (2, "oil pressure low"), (3, "all normal"), (4, "pump pump pump")], ["doc_id", "text"])
    asks = spark.createDataFrame([(10, "pump leak"), (11, "zzz unknown")], ["query_id", "text"])
    return docs, asks


def test_tfidf_ranks_and_drops_zero_scores(corpus):
    out = retrieval.tfidf_top_k(*corpus).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["doc_id"]) for r in out] == [(10, 1), (10, 4)] or {r["doc_id"] for r in out} == {1, 4}
    assert all(0 < r["score"] <= 1 + 1e-9 for r in out)


@pytest.mark.parametrize("block,batch", [(1024, 64), (3, 2), (1, 1)])
def test_blocks_and_batches_give_what_brute_force_gives(spark, monkeypatch, block, batch):
    monkeypatch.setattr(retrieval, "BLOCK_DOCS", block)
    monkeypatch.setattr(retrieval, "BATCH_QUERIES", batch)
    rng = random.Random(block)

    def some(n, whole):
        return [(f"k{i}", [(f"t{t}", 1.0 if whole else rng.choice((0.25, 0.5, 2.0))) for t in sorted(rng.sample(range(12), rng.randrange(0, 7)))]) for i in range(n)]

    for whole in (True, False):  # whole weights: many equal scores
        docs, asks = some(40, whole), some(9, whole)
        ddl = "{} string, terms array<struct<term string, w double>>"
        got = retrieval.top_k(spark.createDataFrame(docs, ddl.format("d")), spark.createDataFrame(asks, ddl.format("q")), 4, "d", "q")
        want = set()
        for q, terms in asks:
            own = dict(terms)
            scores = sorted((-sum(w * own.get(t, 0) for t, w in ts), d) for d, ts in docs)
            want |= {(q, d, -s, i + 1) for i, (s, d) in enumerate(scores[:4]) if s < 0}
        assert {(r["q"], r["d"], r["score"], r["rank"]) for r in got.collect()} == want


def test_tfidf_counts_terms_in_tasks_and_equals_brute_force(spark):
    """Equal keys are one text, NULL texts count as documents, rare terms fall out; one row per key leaves a task."""
    rng = random.Random(4)
    names = ["pump", "Seal", "öl", "x", "leak", "low", "high", "x1", "seal_2"]
    docs = [(i % 40, " ".join(rng.choice(names) for _ in range(rng.randrange(0, 9)))) for i in range(50)] + [(90, None), (91, "")]
    asks = [(i, " ".join(rng.choice(names) for _ in range(4))) for i in range(6)]

    def grams(text):
        words = [w.lower() for w in (text or "").split() if len(w) > 1]
        return words + [f"{a} {b}" for a, b in zip(words, words[1:])]

    total, df = Counter(t for _, x in docs for t in grams(x)), Counter(t for _, x in docs for t in set(grams(x)))
    idf = {t: math.log((1 + len(docs)) / (1 + df[t])) + 1 for t, _ in sorted(total.items(), key=lambda p: (-p[1], p[0]))[:30]}
    d, a = spark.createDataFrame(docs, "doc_id int, text string").repartition(3), spark.createDataFrame(asks, "query_id int, text string")
    vocab = retrieval._vocabulary(d, "text", 30).collect()
    assert {r["term"]: r["idf"] for r in vocab} == pytest.approx(idf) and len(total) > 30

    def vectors(rows):
        out = {}
        for key, text in rows:
            out.setdefault(key, Counter()).update(t for t in grams(text) if t in idf)
        lengths = {k: math.sqrt(sum((n * idf[t]) ** 2 for t, n in c.items())) for k, c in out.items()}
        return {k: {t: n * idf[t] / lengths[k] for t, n in c.items()} for k, c in out.items() if c}

    got = {r["doc_id"]: {vocab[t["term"]]["term"]: t["w"] for t in r["terms"]} for r in retrieval._vectors(d, "doc_id", "text", vocab).collect()}
    want = vectors(docs)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    best = {}
    for q, terms in vectors(asks).items():
        scores = sorted((-round(sum(w * own.get(t, 0) for t, w in terms.items()), 9), k) for k, own in want.items())
        best[q] = [k for s, k in scores[:6] if s < 0]
    found = retrieval.tfidf_top_k(d, a, max_terms=30).orderBy("query_id", "rank").collect()
    assert {q: [r["doc_id"] for r in found if r["query_id"] == q] for q in best} == best


def test_words_are_counted_in_bounded_steps(monkeypatch):
    monkeypatch.setattr(retrieval, "_STEP", 3)
    lists = pa.array([["x"]] * 4 + [[], ["a"] * 9, [], ["b", "c"]])
    steps = retrieval._steps(lists)
    assert [i for a, b in steps for i in range(a, b)] == list(range(8))
    assert all(sum(map(len, lists[a:b].to_pylist())) <= 3 or b - a == 1 for a, b in steps)
    row, code, own = retrieval._grams(lists.slice(5))
    order = sorted(set(code))
    spelt = dict(zip(order, retrieval._spelt(retrieval.np.array(order), own).to_pylist()))
    assert Counter((r, spelt[c]) for r, c in zip(row.tolist(), code.tolist())) == {(0, "a"): 9, (0, "a a"): 8, (2, "b"): 1, (2, "c"): 1, (2, "b c"): 1}


def test_no_rows_per_pair(spark, monkeypatch):
    """A term that every document holds costs one row per block and query, and hopeless blocks aren't scored."""
    monkeypatch.setattr(retrieval, "BLOCK_DOCS", 50)
    docs = spark.range(2000).select(F.col("id").alias("d"), F.array(F.struct(F.lit("all").alias("term"), (F.lit(1.0) / (1 + F.pmod(F.xxhash64("id"), F.lit(40)))).alias("w"))).alias("terms"))
    asks = spark.range(3).select(F.col("id").alias("q"), F.array(F.struct(F.lit("all").alias("term"), F.lit(1.0).alias("w"))).alias("terms"))
    d, q = docs.withColumn("block", F.pmod(F.xxhash64("d"), F.lit(40))), asks.withColumn("batch", F.lit(0))
    assert retrieval._bounds(d, q, "q").count() == 3 * 40
    best = sorted(r["d"] for r in docs.filter("terms[0].w = 1").collect())[:6]
    got = retrieval.top_k(docs, asks, 6, "d", "q").orderBy("q", "rank").collect()
    assert [r["d"] for r in got] == best * 3


def test_keyword_and_fallback(corpus):
    out = retrieval.keyword_top_k(*corpus).orderBy("query_id", "rank").collect()
    assert [(r["doc_id"], r["score"]) for r in out if r["query_id"] == 10] == [(1, 2.0), (4, 1.0)]
    assert [(r["doc_id"], r["source"]) for r in out if r["query_id"] == 11] == [(1, "fallback"), (2, "fallback"), (3, "fallback")]


def test_row_documents_skip_nulls(spark):
    df = spark.createDataFrame([(1, "A", None)], "i int, m string, t double")
    assert retrieval.row_documents(df, "i").first()["text"] == "row_id=1 | m=A"


def test_profile_texts(spark):
    df = spark.createDataFrame([(1,)], ["x"])
    assert len(stats.profile_recommendations(df)) == 4
    assert stats.recommendation_rows(df).count() == 4


def test_correlation_guard(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], ["a", "b"])
    cells = {(r["x"], r["y"]): r["corr"] for r in stats.correlation_matrix(df, ["a", "b"]).collect()}
    assert cells[("a", "a")] == pytest.approx(1.0) and cells[("a", "b")] is None


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(i),) for i in range(31)], ["x"])
    out = stats.histogram(df, "x", bins=30).collect()
    assert sum(r["n"] for r in out) == 31 and max(r["bin"] for r in out) == 29
    flat = stats.histogram(spark.createDataFrame([(4.0,), (4.0,)], ["x"]), "x")
    assert [tuple(r) for r in flat.collect()] == [(0, 4.0, 4.0, 2)]
