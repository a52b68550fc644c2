from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import functions as F

from rivetwatch.llm.hosts import host_rates, judge


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered),
            n < 20 or 100 * len(covered) > 30 * n)


def test_counts_against_brute_force(spark, sf):
    odd = [(9001, None, None), (9002, "", "x"), (9003, "a b c d e f g h " * 40, None), (9003, "a b c d e f g h " * 40, None),
           (None, "\x0b\x0c \n\n ü%% x\x1cy", "x"), (9004, "w " * 100_000, "y"), (9005, "same\n \nsame\n\tsame\nsame ", "x")]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source")
    docs = docs.union(spark.createDataFrame(odd, docs.schema)).withColumn("kept", F.lit(3)).withColumn("host", F.lit("h"))
    got = judge(docs).collect()
    want = [(r.doc_id, *brute(r.text)) for r in docs.collect()]
    assert sorted((tuple(r)[:7] for r in got), key=str) == sorted(want, key=str)
    assert not any(r.kept and r.base_failed for r in got)
    assert judge(docs.limit(0)).count() == 0


def test_small_hosts_are_pulled_to_the_mean_and_bad_hosts_fall(spark):
    good = " ".join(f"w{i}" for i in range(30))
    rows = [(f"good{h}", good if i % 10 else "short") for h in range(8) for i in range(50)]
    rows += [("bad", "short" if i % 20 else good) for i in range(60)] + [("tiny", "short"), ("tiny", good), (None, good)]
    docs = spark.createDataFrame([(i, t, h) for i, (h, t) in enumerate(rows)], "doc_id long, text string, source string")
    failures = docs.select(F.col("source").alias("host"), (F.col("text") == "short").alias("base_failed"))
    rates = {r.host: r for r in host_rates(failures).collect()}
    mean = sum(r.n_failed for r in rates.values()) / sum(r.n for r in rates.values())
    assert mean < rates["tiny"].rate < 0.5 and rates["bad"].rate > 0.8 and abs(rates["good0"].rate - 0.1) < 0.02
    kept = {r.doc_id: r.kept for r in judge(docs).collect()}
    for i, (h, t) in enumerate(rows):
        assert kept[i] == (t == good and h != "bad")
