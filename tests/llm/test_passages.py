from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from rivetwatch.llm import passages
from rivetwatch.llm.passages import digests, without_repeats


def brute(rows, window=50):
    first: dict = {}
    words = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in words:
        for i in range(len(w) - window + 1) if d is not None else ():
            g = tuple(w[i : i + window])
            first[g] = min(first.get(g, d), d)
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - window + 1) if d is not None else ():
            if first[tuple(w[i : i + window])] < d:
                gone |= set(range(i, i + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def check(df, rows, window=50):
    assert sorted(map(tuple, digests(df, window).collect()), key=str) == brute(rows, window)


@pytest.mark.parametrize("docs", [1024, 5])
def test_planted_repeats(spark, monkeypatch, docs):
    monkeypatch.setattr(passages, "BATCH_DOCS", docs)
    monkeypatch.setattr(passages, "BUCKET_WINDOWS", 40)
    rng = random.Random(8)

    def fresh(n):
        return [f"w{rng.randrange(10**7)}" for _ in range(n)]

    shared = [fresh(n) for n in (49, 50, 51, 74, 75, 120, 400)]
    rows = []
    for d in rng.sample(range(10_000), 60):
        w = fresh(rng.randint(0, 90))
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randint(0, max(0, len(s) - 60))
            w += s[a : a + rng.randint(40, 140)] + fresh(rng.randint(0, 30))
        rows.append((d, " ".join(w)))
    rows += [(20_000 + i, rows[3][1]) for i in range(12)] + [(30_000, "same " * 300), (30_001, "same " * 120), (30_002, "ab ab " * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(df, rows)


def test_odd_rows(spark):
    long_ = " ".join(f"v{i}" for i in range(60_000))
    rows = [(5, None), (6, ""), (3, long_), (9, long_), (9, long_), (None, long_), (10, "\x0b ".join(f"v{i}" for i in range(70))), (2, "few words"),
            (11, " ".join(f"v{i}\x1cu" for i in range(60)))]
    df = spark.createDataFrame([(d, t, 0, "s") for d, t in rows], "doc_id long, text string, n_words int, batch string")
    check(df, rows)
    assert digests(df.limit(0)).collect() == []


def test_kept_text_keeps_its_layout_and_columns(spark):
    passage = " ".join(f"p{i}" for i in range(55))
    rows = [(1, f"first line\n{passage}\nend", "a"), (2, f"Other\n\nrow {passage} tail\n", "b"), (3, "x\n y", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: (r.source, bytes(r.kept).decode(), r.n_removed) for r in without_repeats(df, keep=["doc_id", "source"]).collect()}
    assert got == {1: ("a", rows[0][1], 0), 2: ("b", "Other\n\nrow tail\n", 55), 3: ("c", "x\n y", 0)}


def test_whole_table_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check(df, [(r.doc_id, r.text) for r in df.collect()])
    assert digests(df).agg(F.sum("n_removed")).first()[0] > 0
