from __future__ import annotations

from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from rivetwatch.llm import mixing, toxicity
from rivetwatch.llm.common import stored

from .test_forest import brute as near_brute
from .test_mixing import reshared
from .test_passages import brute as passage_brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf):
    """What each stage returned on a table with planted rows, in order, from the input on."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = [r.text for r in docs.orderBy("doc_id").limit(40).collect()]
    passage = " ".join(f"passage{i}" for i in range(70))
    planted = [(9_000 + i, t, "en", "src1", len(t)) for i, t in enumerate(texts[:15])]
    planted += [(9_100 + i, f"only{i} begins {passage} ends{i}", "en", "src2", 1) for i in range(4)] + [(9_200, passage, "en", None, 1), (9_300, None, None, None, None), (9_301, "", "de", "src3", 0)]
    out = [docs.union(spark.createDataFrame(planted, docs.schema))]
    for name, f in corpus_pipeline.STAGES:
        out.append(stored(f(spark, out[-1], sf), name))
    return out


def rows(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_all_but_the_last_return_documents(stages):
    assert [s.columns for s in stages[:-1]] == [COLUMNS] * 5
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near-dedup", "substring-dedup", "mix", "encode"]


def test_toxic_documents_go(spark, sf, stages):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scores = toxicity.toxicity(stages[0], labels).collect()
    bad = {s.doc_id for s in scores if s.score >= 0.5}
    assert rows(stages[1]) == Counter({k: n for k, n in rows(stages[0]).items() if k[0] not in bad})


def test_one_of_each_group_stays(stages):
    before = [(r.doc_id, r.text) for r in stages[1].collect()]
    keep = {d for d, _, c in near_brute(before) if c is None or d == c}
    assert rows(stages[2]) == Counter(r for r in before if r[0] in keep)
    assert len(keep) < len(before)


def test_repeats_are_cut(stages):
    before = [(r.doc_id, r.text) for r in stages[2].collect()]
    want = {d: (n, gone) for d, n, gone, _ in passage_brute(before)}
    after = {r.doc_id: (r.text, r.n_chars) for r in stages[3].collect()}
    assert set(after) == {d for d, (n, gone) in want.items() if gone == 0 or gone < n}
    for d, text in before:
        if d in after:
            assert len(after[d][0].encode().split()) == want[d][0] - want[d][1] and after[d][1] == len(after[d][0])
            assert want[d][1] or after[d][0] == (text or "")
    assert any(gone for _, gone in want.values())


def test_sources_come_near_their_targets(stages):
    size, taken = defaultdict(int), defaultdict(int)
    for r in stages[3].collect():
        size[r.source] += len(r.text.encode().split())
    for r in stages[4].collect():
        taken[r.source] += len(r.text.encode().split())
    longest = max(len(r.text.split()) for r in stages[3].collect())
    for s, t in reshared(size).items():
        assert abs(taken[s] - t) <= longest / 2
    assert max(rows(stages[4]).values()) <= mixing.MAX_COPIES
    assert set(rows(stages[4])) <= set(rows(stages[3]))


def test_ids_are_the_library_s(stages):
    library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    want = Counter((r.doc_id, tuple(library.encode(r.text, add_special_tokens=False).ids)) for r in stages[4].collect())
    got = stages[5].collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want and all(r.round_trip and r.n_tokens == len(r.ids) for r in got)


def test_run_is_the_chain_and_agrees_with_itself(spark, sf):
    digest = [F.count("*"), F.sum("n_tokens"), F.sum(F.xxhash64("doc_id", "ids") % 1_000_003)]
    a, b = corpus_pipeline.run(spark, sf).agg(*digest).first(), corpus_pipeline.run(spark, sf).agg(*digest).first()
    assert a == b and a[0] > 0


def test_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for name, f in corpus_pipeline.STAGES:
        docs = stored(f(spark, docs, sf), name)
        assert docs.count() == 0
