from __future__ import annotations

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from rivetwatch.llm.mixing import MAX_COPIES, WEIGHTS, mix


def reshared(sizes):
    """Targets by sharing out again and again, as stated."""
    names = sorted([s for s in sizes if s is not None]) + [s for s in sizes if s is None]
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(names)}
    target = dict.fromkeys(names, 0.0)
    left, open_ = float(sum(sizes.values())), set(names)
    while left > 1e-6 and open_:
        w = sum(weight[s] for s in open_)
        give, left = left, 0.0
        for s in list(open_):
            target[s] += give * weight[s] / w
            if target[s] >= MAX_COPIES * sizes[s]:
                left += target[s] - MAX_COPIES * sizes[s]
                target[s] = float(MAX_COPIES * sizes[s])
                open_.discard(s)
    return target


def check(docs):
    rows = docs.select("doc_id", "source", "text").collect()
    got = mix(docs).collect()
    assert len(got) == len(rows)
    size = {r.doc_id: len((r.text or "").encode().split()) for r in rows}
    per = defaultdict(int)
    source = {r.doc_id: r.source for r in rows}
    for r in rows:
        per[r.source] += size[r.doc_id]
    target, taken, longest = reshared(per), defaultdict(int), defaultdict(int)
    for r in got:
        s = source[r.doc_id]
        assert r["size"] == size[r.doc_id] and r.source_size == per[s] and r.target == pytest.approx(target[s], abs=1e-3)
        assert r.taken == r["size"] * r.copies and 0 <= r.copies <= MAX_COPIES
        taken[s] += r.taken
        longest[s] = max(longest[s], r["size"])
    for s in per:
        assert abs(taken[s] - target[s]) <= longest[s] / 2 + 1e-6
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mix(docs.repartition(7)).collect()), key=str)


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = [(7001, None, None), (7002, "", None), (7003, "alone in its source", "zzz"), (7004, "x " * 40_000, "aaa"), (7005, "no source here", None)]
    check(docs.select("doc_id", "text", "source").union(spark.createDataFrame(extra, "doc_id long, text string, source string")).withColumn("target", F.lit(1)))


def test_empty_table_repeats_and_one_source(spark):
    schema = "doc_id long, text string, source string"
    assert mix(spark.createDataFrame([], schema)).collect() == []
    one = spark.createDataFrame([(1, "a b c", "s"), (1, "a b c", "s"), (None, "d", "s")], schema)
    assert [r.taken for r in mix(one).orderBy("size").collect()] == [1, 3, 3]
    nothing = spark.createDataFrame([(1, None, "s"), (2, " ", None)], schema)
    assert [(r.target, r.taken) for r in mix(nothing).collect()] == [(0.0, 0), (0.0, 0)]


def test_chances_follow_the_fractions(spark):
    """Over many seeds, long documents are drawn about as often as their share says, short ones half as often."""
    rows = [(i, "w " * 100, "a") for i in range(60)] + [(100 + i, "w " * 20, "a") for i in range(60)] + [(1000 + i, "w " * 100, "b") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").cache()
    long_, short = [], []
    for seed in range(6):
        got = {r.doc_id: r.copies for r in mix(docs, seed=seed).collect()}
        long_ += [got[i] for i in range(60)]
        short += [got[100 + i] for i in range(60)]
    assert sum(short) / len(short) == pytest.approx(sum(long_) / len(long_) / 2, abs=0.12)
