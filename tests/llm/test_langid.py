from __future__ import annotations

import random

from pyspark.sql import functions as F

from rivetwatch.llm import langid
from rivetwatch.llm.langid import identify, learn, phrases, suffix_automaton, symbols_of


def test_automaton_accepts_exactly_the_substrings():
    rng = random.Random(1)
    for _ in range(30):
        s = [rng.randrange(3) for _ in range(rng.randint(0, 25))]
        nexts = suffix_automaton(s)
        inside = {()} | {tuple(s[i:j]) for i in range(len(s)) for j in range(i, len(s) + 1)}
        for _ in range(200):
            probe, state = [rng.randrange(3) for _ in range(rng.randint(0, 8))], 0
            for c in probe:
                state = nexts[state].get(c) if state is not None else None
            assert (state is not None) == (tuple(probe) in inside)


def greedy(flow, reference):
    n = at = 0
    while at < len(flow):
        size = 1
        while at + size < len(flow) and flow[at : at + size + 1] in reference and flow[at : at + size] in reference:
            size += 1
        n, at = n + 1, at + size
    return n


def test_phrases_against_greedy_search():
    rng = random.Random(2)
    samples = {"a": ["".join(rng.choices("abc d", k=300))], "b": ["".join(rng.choices("xyz d", k=300))]}
    model = learn(samples)
    texts = ["".join(rng.choices("abcxyzQ d", k=rng.randint(1, 200))) for _ in range(60)] + ["abc"]
    flows = [symbols_of(t, model.symbol) for t in texts]
    got = phrases(model, flows)
    for k, lang in enumerate(model.languages):
        reference = bytes(symbols_of(samples[lang][0], model.symbol))
        assert got[:, k].tolist() == [greedy(bytes(f), reference) for f in flows]


def test_held_out_accuracy_and_odd_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null")
    right, n = got.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 150 and right / n > 0.97
    odd = spark.createDataFrame([(1, None, "en"), (2, "", None), (3, "12 -- 34!", "en"), (None, "the and of", "en"), (4, "the " * 50_000, "en"), (4, "the " * 50_000, "en")],
                                "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    rows = identify(odd).collect()
    assert [r.lang_pred for r in sorted(rows, key=lambda r: r.doc_id or 0)] == ["en", "und", "und", "und", "en", "en"]
    assert all(0 <= r.score <= 1 for r in rows)
    assert identify(odd.limit(0)).count() == 0
    assert {r.lang_pred for r in identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_learning_sample_is_bounded_and_leaves_the_test_fold_out(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("doc "), F.col("id")).alias("text"), F.lit("en").alias("lang"))
    texts = langid.sample(docs)["en"]
    held = {f"doc {r.doc_id}" for r in docs.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2).collect()}
    assert len(texts) == langid.SAMPLE_DOCS and not held & {*texts}


def test_all_letters_of_many_scripts_are_told_apart(spark):
    rng = random.Random(3)
    # 600 letters for each of two languages out of the same 900 ideographs, syllables, kana and Cyrillic.
    words = {"zh": (0x4E00, 900, 600), "zy": (0x4E00, 900, 600), "ko": (0xAC00, 800, 800), "ja": (0x3041, 80, 80), "ru": (0x430, 32, 32)}
    vocabulary = {}
    for lang, (first, span, n) in words.items():
        letters = rng.sample(range(first, first + span), n)
        vocabulary[lang] = ["".join(chr(c) for c in rng.choices(letters, k=rng.randint(2, 5))) for _ in range(400)]
    texts = {lang: [" ".join(rng.choices(own, k=200)) for _ in range(60)] for lang, own in vocabulary.items()}
    model = learn({lang: own[:40] for lang, own in texts.items()})
    samples = {lang: own[:1] for lang, own in texts.items()}
    small = learn(samples)
    flows = [symbols_of(own[50], small.symbol) for own in texts.values()]
    got = phrases(small, [f[:200] for f in flows])
    for k, lang in enumerate(small.languages):
        reference = "".join(map(chr, symbols_of(samples[lang][0][: langid.DOC_CHARS], small.symbol)))
        assert got[:, k].tolist() == [greedy("".join(map(chr, f[:200])), reference) for f in flows]
    assert len(model.keys) and model.n_symbols == 4 + langid.LETTERS
    rows = [(d, t, lang) for d, (lang, t) in enumerate((lang, t) for lang, own in texts.items() for t in own)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = identify(df).join(df.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(out) > 50 and all(r.lang == r.lang_pred for r in out)
