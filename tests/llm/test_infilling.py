from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from rivetwatch.llm import infilling
from rivetwatch.llm.infilling import Marked, begins_of, digests, marks_of, restore, transform

DDL = "doc_id long, text string"


def brute(d, text, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    s = hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(s[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, x = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not text or any(t in text for t in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return d, len(units), "plain", None, None, text
    if h4 % 100 < spm:
        return d, len(units), "spm", len(p), len(m), f"<S>{x}<P>{p}<M>{m}"
    return d, len(units), "psm", len(p), len(m), f"<P>{p}<S>{x}<M>{m}"


def check(spark, rows, **settings):
    got = sorted(map(tuple, transform(spark.createDataFrame(rows, DDL), **settings).collect()), key=str)
    assert got == sorted((brute(*r, **settings) for r in rows), key=str)
    return got


@pytest.mark.parametrize("size", [1 << 23, 64])
def test_equals_split_lines(spark, monkeypatch, size):
    monkeypatch.setattr(infilling, "SLICE_BYTES", size)
    rng = random.Random(13)
    alphabet = ["\n", "\n", "a", "\u008a", "é", "中", "😀", "\r", "\x0b", " ", "\x8a", "J", " "]
    rows = [(rng.randrange(10**9), "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 70)))) for _ in range(500)]
    forms = {r[2] for r in check(spark, rows)}
    assert forms == {"plain", "spm", "psm"}
    check(spark, rows[:50], rate=40, spm=10)


def test_empty_marked_repeated_and_without_id(spark):
    rows = [(1, None), (2, ""), (3, "\n"), (4, "\n\n\n"), (5, "a<P>b\nc"), (6, "x<S>\n"), (7, "<M>"), (8, "< P>\n<s>"), (None, "a\nb\n"), (None, "a\nb\n"), (9, "a\nb"), (9, "c\n" * 9)]
    check(spark, rows)
    check(spark, [])


def test_digests_and_round_trip(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {d: (brute(d, t)[5], t or "") for d, t in docs.select("doc_id", "text").collect()}
    for r in digests(docs.withColumn("form", docs.lang)).collect():
        out, text = want[r.doc_id]
        assert r.output_sha256 == hashlib.sha256(out.encode()).hexdigest()
        assert r.restored_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert restore(out.encode(), r.form) == text.encode()


def test_long_text(spark):
    rows = [(i, "line é\n" * 200_000 + "end") for i in range(3)] + [(9, "x" * 2_000_000)]
    check(spark, rows)


def test_marks_rank_and_select():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 8 * 500).astype(np.uint8)
    data[rng.random(len(data)) < 0.3] = 10
    words = data.view("<u8")
    for byte in (0, 10, 11, 127, 128, 138, 255):
        assert (((marks_of(words, byte).view(np.uint8)) == 128) == (data == byte)).all()
    assert ((begins_of(words).view(np.uint8) == 128) == ((data & 0xC0) != 0x80)).all()
    m = Marked(marks_of(words, 10))
    at = np.flatnonzero(data == 10)
    assert (m.select(np.arange(len(at))) == at).all()
    every = np.arange(len(data) + 1)
    assert (m.rank(every) == np.searchsorted(at, every)).all()


def test_slices_of_a_batch():
    texts = pa.array(["a\n", "bb\nc", "", "\n"] * 5).slice(3, 9)
    ids = list(range(9))
    whole = infilling.plan(ids, texts)
    for i in ids:
        one = infilling.plan([i], texts.slice(i, 1))
        assert all(one[k][0] == whole[k][i] for k in whole)
