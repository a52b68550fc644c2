from __future__ import annotations

import random

import numpy as np
import pytest

from rivetwatch.llm import forest
from rivetwatch.llm.common import WordHashes
from rivetwatch.llm.components import connected
from rivetwatch.llm.forest import candidates, near_duplicates, shingles, signature


def brute(rows, width=5, percent=80):
    sets = []
    for d, t in rows:
        w = (t or "").encode().lower().split()
        k = min(width, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w and d is not None else set())
    lists: dict = {}
    for i, s in enumerate(sets):
        for x in s:
            lists.setdefault(x, []).append(i)
    common: dict = {}
    for own in lists.values():
        for a in range(len(own)):
            for b in range(a):
                common[own[b], own[a]] = common.get((own[b], own[a]), 0) + 1
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            up[find(a)] = find(b)
    least: dict = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return {(d, (len(sets[i]) if d is not None else None), least.get(find(i))) for i, (d, _) in enumerate(rows)}


def got(df, **kw):
    out = near_duplicates(df, **kw).collect()
    assert all(r.kept == (r.component_id is None or r.doc_id == r.component_id) for r in out)
    return out


def as_set(out):
    return {(r.doc_id, r.n_shingles if r.doc_id is not None else None, r.component_id) for r in out}


def edits(seed, n, words=80, most=8):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, most)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("region,block", [(1024, 256), (20, 16)])
def test_large_groups_and_chains(spark, monkeypatch, region, block):
    monkeypatch.setattr(forest, "BLOCK", block)
    monkeypatch.setattr(candidates, "__defaults__", (region, forest.HINT))
    monkeypatch.setattr(forest.confirmed, "__defaults__", (block,))
    texts = [t for s in range(3) for t in edits(s, 110)]
    chain = [f"c{i}" for i in range(200)]
    texts += [" ".join(chain[i : i + 60]) for i in range(0, 140, 5)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert as_set(got(df)) == brute(rows)


def test_odd_rows(spark):
    rows = [(5, "One Two"), (3, "one two"), (9, "one  two three"), (7, None), (8, ""), (None, "one two"), (None, None), (5, "One Two"),
            (11, "É one"), (12, "é one"), (20, "long " * 60_000), (21, "long long long long long long"), (22, " \x0b ")]
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, node int, component_id int")
    out = got(df)
    assert len(out) == len(rows) and as_set(out) == brute(rows)
    assert near_duplicates(df.limit(0)).collect() == []


def test_whole_table_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert as_set(got(df, width=4)) == brute(rows, width=4)


def test_signatures_estimate_similarity():
    h = WordHashes()
    a, b = edits(1, 2, words=400, most=8)
    x, y = (shingles(t.encode(), 4, h) for t in (a, b))
    true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    assert abs((signature(x) == signature(y)).mean() - true) < 0.15
    many = [signature(np.random.default_rng(i).integers(0, 1 << 64, 300, dtype=np.uint64)) for i in range(200)]
    assert np.mean([(many[i] == many[i + 1]).mean() for i in range(199)]) < 0.002


def test_components_of_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 40)] + [(5000 - i, 5000) for i in range(1, 30)] + [(7, 7)]
    out = {r.node: r.component for r in connected(spark.createDataFrame(path, "a long, b long")).collect()}
    assert out == {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(40)} | {5000 - i: 4971 for i in range(30)}
    assert connected(spark.createDataFrame([], "a long, b long")).collect() == []


def test_full_regions_lose_no_link(spark):
    # 3,000 distinct near copies, pairs at about 0.8: each ends in words of its own, so what differs in a signature is shared by none.
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    rows = []
    for d in range(3000):
        rows.append((d, " ".join(base + [f"x{rng.randrange(10**9)}" for _ in range(rng.randint(45, 54))])))
    h = WordHashes()
    sets = [shingles(t.encode(), 5, h) for _, t in rows]
    values, count = np.unique(np.concatenate(sets), return_counts=True)
    shared = values[count > 1]
    held = np.zeros((len(rows), len(shared)), np.float32)
    for i, s in enumerate(sets):
        own = s[np.isin(s, shared)]
        held[i, np.searchsorted(shared, own)] = 1
    common, n = held @ held.T, np.array([len(s) for s in sets])
    link = 100 * common >= 80 * (n[:, None] + n[None, :] - common)
    least = np.arange(len(rows))
    while True:
        now = np.where(link, least[None, :], len(rows)).min(axis=1)
        if (now == least).all():
            break
        least = now
    assert 0.3 < link.mean() < 0.9
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert as_set(got(df)) == {(d, int(n[d]), int(least[d])) for d in range(len(rows))}
