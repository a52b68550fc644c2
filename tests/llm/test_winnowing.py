from __future__ import annotations

import hashlib
import random
import re

import pytest

from rivetwatch.llm import winnowing
from rivetwatch.llm.winnowing import decontaminate

DOC = "doc_id long, text string"
ITEM = "item_id string, text string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, span=10):
    runs: dict = {}
    for item, text in items:
        w = words(text)
        n = min(span, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            runs.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for d, text in docs:
        w = words(text)
        hit, named = set(), set()
        for n in {len(r) for r in runs}:
            for i in range(len(w) - n + 1):
                found = runs.get(tuple(w[i : i + n]))
                if found:
                    hit |= set(range(i, i + n))
                    named |= found - {None}
        out.append((d, len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def check(spark, docs, items, span=10):
    got = decontaminate(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM), span)
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items, span)


@pytest.mark.parametrize("block", [4096, 7])
def test_every_shared_run_is_found(spark, monkeypatch, block):
    monkeypatch.setattr(winnowing, "BLOCK", block)
    rng = random.Random(11)

    def some(n, of=400):
        return [f"w{rng.randrange(of)}" for _ in range(n)]

    items = [[*some(n, 10**6)] for n in (1, 3, 9, 10, 11, 25, 40)]
    items.append(["a"] * 30)  # ties in every window
    docs = []
    for d in range(60):
        text = some(rng.randrange(0, 60))
        for _ in range(rng.randrange(0, 3)):
            item = rng.choice(items)
            a = rng.randrange(len(item))
            at = rng.randrange(len(text) + 1)
            text[at:at] = item[a : a + rng.choice((5, 9, 10, 11, 40))]
        docs.append((d, rng.choice((" ", "\n", ", ", "--")).join(w.upper() if rng.random() < 0.2 else w for w in text)))
    check(spark, docs, [(f"i{k}", " ".join(w)) for k, w in enumerate(items)])


def test_nulls_ties_repeats_and_other_alphabets(spark):
    shared = "Ärger über 12 grüne Äpfel am Rand der großen Stadt heute"
    docs = [(1, None), (2, ""), (3, "..."), (None, shared), (None, shared), (4, shared.lower()), (4, "x " + shared), (5, "ÄRGER " + shared[6:]),
            (6, "eins zwei"), (7, "中文 " * 12), (2**62, "a_b c" * 3)]
    items = [("b", shared), ("a", shared), ("a", shared), (None, shared), (None, "eins zwei"), ("z", None), ("y", "!"), ("c", "中文 " * 10)]
    check(spark, docs, items)
    check(spark, docs, [])
    check(spark, [], items)
    check(spark, docs, items, span=4)


def test_other_columns_don_t_clash(spark):
    docs = spark.createDataFrame([(1, "one two three", 5, "x", 2)], DOC + ", row int, block string, n int")
    items = spark.createDataFrame([("i", "two three", 1)], ITEM + ", id int")
    assert [tuple(r)[:4] for r in decontaminate(docs, items).collect()] == [(1, 3, 2, 1)]


def test_a_long_text_and_a_passage_everywhere(spark):
    rng = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(14))
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(60_000))
    docs = [(0, f"{long} {passage} {long} {passage}"), *((d, f"d{d} {passage} e{d}") for d in range(1, 400))]
    check(spark, docs, [(f"i{k}", f"{passage} q{k}") for k in range(30)])


def test_no_python_on_the_way(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    plan = decontaminate(docs, items)._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas", "MapPartitions"))
