"""Quality rules judged by host: failures counted per host, rates shrunk by an empirical beta prior, verdicts joined back.

A document fails its own rules if it has fewer than ``MIN_WORDS`` words or if more than ``MAX_REPEAT`` percent of its
words lie in word windows that occur twice or more in it.  A host's raw failure rate says little where it has few
documents, so a beta prior is fitted to all hosts by moments (mean and excess of the spread over what chance gives)
and every host gets its posterior mean.  Hosts above ``MAX_RATE`` lose all their documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import SPACES, WordHashes, rolling, stored

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT = 30
MAX_RATE = 0.5
# Bounds of the prior's strength (documents it counts for), for corpora whose hosts differ less or more than it can say.
MIN_STRENGTH, MAX_STRENGTH = 1.0, 1e6

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(hashes: np.ndarray, width: int = WINDOW) -> int:
    """Words that lie in a run of ``width`` words found at two places or more."""
    h = rolling(hashes, width)
    if len(h) < 2:
        return 0
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(hashes) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + width, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def measured(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host and the counts of every document's whole text (null: no words); no shuffle."""

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            rows = []
            for value in batch.column(2):
                text = value.as_py()
                words = text.split()
                lines = [x for x in text.split(b"\n") if x.strip(SPACES)]
                chars = len(text.translate(None, SPACES).decode()) if words else 0
                symbols = len(text) - len(text.translate(None, b"#*$%&|<>"))
                rows.append((len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(hashes.of(words))))
            counts = np.array(rows, np.int64).reshape(-1, len(_COUNTS))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c) for c in counts.T]], ["doc_id", "host", *_COUNTS])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"),
                      F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return own.mapInArrow(run, "doc_id long, host string, " + ", ".join(f"{c} long" for c in _COUNTS))


def host_rates(failures: DataFrame) -> DataFrame:
    """Per host (null is one): n, n_failed and the posterior mean ``rate`` of ``base_failed`` rows.

    Prior by moments: mean m over all documents, intra-host correlation r from the weighted spread of the hosts' rates,
    strength 1/r - 1 within fixed bounds (the upper one where hosts differ by no more than chance).
    """
    hosts = failures.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    n, f = F.col("n").cast("double"), F.col("n_failed").cast("double")
    overall = hosts.agg(F.sum("n").alias("big_n"), F.sum("n_failed").alias("big_f"), F.count(F.lit(1)).alias("h"),
                        F.sum(F.col("n") * F.col("n")).alias("squares"), F.sum(f * f / n).alias("spread"))
    m = F.col("big_f") / F.col("big_n")
    var = m * (1 - m)
    excess = F.col("spread") - F.col("big_n") * m * m - var * (F.col("h") - 1)
    room = var * (F.col("big_n") - F.col("squares") / F.col("big_n") - (F.col("h") - 1))
    r = F.when((room > 0) & (excess > 0), excess / F.when(room > 0, room))
    strength = F.coalesce(F.least(F.greatest(1 / r - 1, F.lit(MIN_STRENGTH)), F.lit(MAX_STRENGTH)), F.lit(MAX_STRENGTH))
    prior = overall.select(m.alias("mean"), strength.alias("strength"))  # one row
    return hosts.crossJoin(F.broadcast(prior)).select(
        "host", "n", "n_failed", ((f + F.col("strength") * F.col("mean")) / (n + F.col("strength"))).alias("rate"))


def judge(docs: DataFrame, host: str = "source", max_rate: float = MAX_RATE) -> DataFrame:
    """Per document: doc_id, counts, base_failed, kept.

    Null or empty texts have no words and fail; documents without host are judged as one host; repeated rows each
    count and stay; other columns are ignored; no rows give no rows.
    """
    words, repeats = F.col("n_words"), F.col("n_repeat_words")
    rows = measured(docs, host).withColumn("base_failed", (words < MIN_WORDS) | (100 * repeats > MAX_REPEAT * words))
    rows = stored(rows, "rules")  # small: counts only; read for the hosts and for the verdicts
    bad = host_rates(rows).filter(F.col("rate") > max_rate).select(F.col("host").alias("bad_host"), F.lit(True).alias("bad"))
    # Few hosts are bad: the engine broadcasts them when their measured size allows, else splits a hot host's rows.
    joined = rows.join(bad, rows["host"].eqNullSafe(bad["bad_host"]), "left")
    return joined.select("doc_id", *_COUNTS, "base_failed", (~F.col("base_failed") & F.col("bad").isNull()).alias("kept"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)
), twice AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM windows) WHERE c > 1
), repeats AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY 1
), counted AS (
  SELECT d.doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
           - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN repeats USING (doc_id)
), failed AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted
), hosts AS (
  SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS f FROM failed GROUP BY 1
), overall AS (
  SELECT sum(n)::DOUBLE AS big_n, sum(f) / sum(n)::DOUBLE AS m, count(*) AS h, sum(n * n)::DOUBLE AS squares,
         sum(f::DOUBLE * f / n) AS spread FROM hosts
), moments AS (
  SELECT m, spread - big_n * m * m - m * (1 - m) * (h - 1) AS excess, m * (1 - m) * (big_n - squares / big_n - (h - 1)) AS room FROM overall
), prior AS (
  SELECT m, CASE WHEN room > 0 AND excess > 0 THEN least(greatest(room / excess - 1, 1.0), 1e6) ELSE 1e6 END AS k FROM moments
), bad AS (
  SELECT source FROM hosts, prior WHERE (f + k * m) / (n + k) > 0.5
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.source IS NOT DISTINCT FROM failed.source) AS kept
FROM failed
"""
