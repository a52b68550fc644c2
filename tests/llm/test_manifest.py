from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from rivetwatch.llm import manifest
from rivetwatch.llm.manifest import Frontier, digest, folded, verified

DDL = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r):
    d, text, lang, source, n = r
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d, source, lang, n, text)))


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([h(*low[i : i + 2]) for i in range(0, len(low), 2)])
    return levels


def path(levels, i):
    """(siblings, how to fold) from node ``i`` up."""
    out = []
    for low in levels[:-1]:
        other = i ^ 1
        out.append((i % 2, low[other] if other < len(low) else None))
        i //= 2
    return out


def brute(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    own = {k: sorted((r for r in rows if r[2] == k), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for k in langs}
    trees = {k: tree([leaf(r) for r in own[k]]) for k in langs}
    top = tree([trees[k][-1][0] for k in langs])
    out = []
    for j, k in enumerate(langs):
        for i, r in enumerate(own[k]):
            steps = path(trees[k], i) + path(top, j)
            d, text, lang, source, n = r
            bad = d is not None and zlib.crc32(str(d).encode()) % 7 == 0
            f = leaf((d, text, lang, source, None if n is None else n + bad))
            for right, other in steps:
                f = h(f) if other is None else h(other, f) if right else h(f, other)
            root = top[-1][0]
            out.append((d, leaf(r), trees[k][-1][0], root, h(*(o for _, o in steps if o)), f, f == root))
    return sorted(out, key=str)


def check(spark, rows, bits):
    got = verified(spark.createDataFrame(rows, DDL), bits)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


@pytest.mark.parametrize("bits", [1, 2, 3, 12])
def test_blocks_of_any_height(spark, bits):
    rng = random.Random(bits)
    sizes = {"de": 1, "en": 33, "fr": 2, "es": 8, "it": 5, None: 7, "é": 9, "": 4}
    rows = [(rng.randrange(10**6), f"text {k} {i}", k, rng.choice((None, "a", "b")), rng.choice((None, i))) for k, n in sizes.items() for i in range(n)]
    check(spark, rows, bits)


def test_nulls_repeats_and_one_row(spark):
    same = (3, "x", "en", "s", 1)
    rows = [same, same, same, (3, "y", "en", "s", 1), (None, None, None, None, None), (None, "", "en", None, 0), (None, "b", "en", None, 0), (-5, "日本", "日", "ö", 2)]
    check(spark, rows, 1)
    check(spark, rows[:1], 12)
    check(spark, [], 12)


def test_other_columns_and_long_text(spark):
    rows = [(1, "long " * 300_000, "en", "s", 5), (2, "b", "en", "s", 1)]
    wide = spark.createDataFrame([(*r, "x", 7) for r in rows], DDL + ", place string, witness int")
    assert sorted(map(tuple, verified(wide).collect()), key=str) == brute(rows)


def test_one_changed_row_is_told(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "en", "s", i) for i in range(300)], DDL)
    got = {r.doc_id: r.verified for r in verified(docs, 4).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % manifest.TAMPERED != 0 for i in range(300)}


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 13, 16, 31])
def test_frontier_extends_partial_witnesses(n):
    f = Frontier()
    leaves = [h(str(i)) for i in range(n)]
    for i, d in enumerate(leaves):
        f.append(d)
        # What is open is one subtree for each bit of the count, as in a binary counter.
        assert [s[0] for s in f.open] == [b for b in range(10, -1, -1) if (i + 1) >> b & 1]
        # A partial witness leads to the digest of the open subtree that holds the leaf.
        for _, top, below in f.open:
            assert all(folded(leaves[j], "".join(f.witness[j])) == top for j in below)
    root = f.close()
    assert root == tree(leaves)[-1][0] and all(folded(d, "".join(w)) == root for d, w in zip(leaves, f.witness))
    assert digest("a", "b") == h("ab")
