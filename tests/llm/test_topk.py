from __future__ import annotations

import math

import numpy as np
import pytest

from rivetwatch.llm import topk
from rivetwatch.llm.topk import Best, search_block, top_k


def brute(rows, every=50, k=5):
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in ok:
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, c)), i) for i, c in ok if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("big", [False, True])
def test_block_search_prunes_nothing_it_needs(big):
    rng = np.random.default_rng(3)
    c = (rng.normal(size=(3000, 16)) * rng.lognormal(size=(3000, 1)) * 60).astype(np.int64) * ((1 << 20) if big else 1)
    c[100:900] = c[5]
    ids = rng.permutation(3000).astype(np.int64)
    q, q_ids = c[:60], ids[:60]
    axes = np.linalg.svd((c.T @ c).astype(float))[2].T
    best = search_block(q, q_ids, c, ids, axes, 5, np.full(60, -1e300))
    for i in range(60):
        want = sorted((-int(s), int(v)) for s, v in zip(c @ q[i], ids) if v != q_ids[i])[:5]
        assert [(-int(s), int(v)) for s, v in zip(best.score[i], best.vec[i])] == want


def test_best_keeps_smaller_ids_on_ties():
    b = Best(1, 2, np.array([-1e300]))
    b.add(np.array([0, 0, 0]), np.array([0, 1, 2]), np.array([5, 5, 5]), np.array([9, 3, 4]))
    assert b.vec.tolist() == [[3, 4]]


def rows_of(df):
    return [(r.vec_id, r.embedding) for r in df.collect()]


def test_whole_table_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 90)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    assert sorted(map(tuple, top_k(df).collect())) == brute(rows_of(df))


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 5)
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, -0.5]), (50, [0.25, 0.25]), (1, None), (2, [None, 1.0]), (3, [nan, 1.0]), (4, [inf, 0.0]), (None, [9.0, 9.0])]
    rows += [(5, [1.0, 2.0])] * 3 + [(i, [0.5, 0.5]) for i in range(100, 130)] + [(7, [1e-9, -1e-9])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, score int, rank int")
    assert sorted(map(tuple, top_k(df).collect())) == brute(rows)
    few = df.filter("vec_id in (0, 7)")
    assert sorted(map(tuple, top_k(few).collect())) == brute([r for r in rows if r[0] in (0, 7)])
    assert top_k(df.limit(0)).collect() == [] and top_k(df.filter("vec_id = 5")).collect() == []
    assert top_k(df.filter("vec_id = 0")).collect() == []


def test_large_components_are_exact(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 40)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk, "LARGE_BLOCK", 4)
    rng = np.random.default_rng(8)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=4) * 3]) for i in range(150)]
    rows += [(i, [float(np.float32(x)) for x in rng.normal(size=4) * 200_000]) for i in (200, 201, 202, 250, 251, 300)]
    rows += [(400, [200_000.0, 0.0, 0.5, -131_072.0]), (401, [131_072.0, 0.0, 0.0, 0.0]), (402, [131_071.0, 1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, top_k(df).collect())) == brute(rows)
    # Only large queries, and scores beyond a long, which are equal and go by id.
    huge = [(50, [3e30]), (7, [2e30]), (8, [4e30]), (9, [-4e30]), (10, [1.0])]
    got = top_k(spark.createDataFrame(huge, "vec_id long, embedding array<float>")).collect()
    most = (1 << 63) - 1
    assert [(r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(1, 7, most), (2, 8, most), (3, 10, most), (4, 9, -most - 1)]
