"""Mixing sources to target weights: whole copies for certain, the rest by Pareto order sampling.

Every source gets a target of words: its weight's share of all words, but never more than ``MAX_COPIES`` times what it
has; what it can't take is shared again among the others by weight.  Inside a source a document's expected copies are
the same but for documents under ``SHORT`` words, which count ``SHORT_WEIGHT`` of a long one.  Whole copies are given
for certain.  For the fraction p left, documents are ranked by u/(1-u) divided by p/(1-p), u being a hash of doc_id
that behaves like a uniform number; documents are taken in that order as long as that brings the words of the source
nearer to its target.  So the sample's size in words is fixed to within half a document.

No source is sorted or summed in one task: ranks are cut at a place found by two histograms of the ranking value, and
only rows of the one fine bucket in which a source's target falls are ordered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .common import WORD, stored

MAX_COPIES = 3
WEIGHTS = (1, 2, 3)
SHORT, SHORT_WEIGHT = 64, 0.5
SEED = 5
_BUCKETS = 1024


def _size(text: str):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sizes(docs: DataFrame, row: bool = False) -> DataFrame:
    """doc_id, source, number of words of every whole text (null: 0), whether that is short; the whole row as well."""
    own = [F.struct(*docs.columns).alias("row")] if row else []
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), _size("text").alias("size"), *own)
    return out.withColumn("short", F.col("size") < SHORT)


def water_fill(df: DataFrame, by: list[str], cap: str, weight: str, total, share: str) -> DataFrame:
    """``share`` of ``total`` by weight, none above its ``cap``, what is cut off shared again by weight.

    In order of cap over weight the rows that reach their cap are the first ones, so one ordered pass finds them.
    """
    ratio = F.when(F.col(cap) > 0, F.col(cap) / F.col(weight)).otherwise(0.0)
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    line = whole.orderBy(ratio, *[c for c in ("source", "short") if c in df.columns])
    before = F.coalesce(F.sum(cap).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum(weight).over(line.rowsBetween(0, Window.unboundedFollowing))
    out = df.withColumn("_full", (F.col(cap) <= 0) | (F.col(cap) * after <= (total - before) * F.col(weight)))
    gone = F.sum(F.when(F.col("_full"), F.col(cap)).otherwise(0.0)).over(whole)
    rest = F.sum(F.when(F.col("_full"), 0.0).otherwise(F.col(weight))).over(whole)
    return out.withColumn(share, F.when(F.col("_full"), F.col(cap)).otherwise(F.col(weight) * (total - gone) / rest)).drop("_full")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row per source (null is one): source, source_size, target.  Weights repeat along the sources by code point."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # From here on there is one row per source.
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last()))
    ring = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("_w", F.element_at(ring, ((rank - 1) % len(weights) + 1).cast("int")))
    per = per.withColumn("_total", F.sum("source_size").over(Window.partitionBy(F.lit(0))).cast("double"))
    per = per.withColumn("_cap", (F.lit(MAX_COPIES) * F.col("source_size")).cast("double"))
    return water_fill(per, [], "_cap", "_w", F.col("_total"), "target").select("source", "source_size", "target")


def _plan(sized: DataFrame) -> DataFrame:
    """Per source and kind of document: whole copies, fraction, and the words the fractions have to bring."""
    goal = targets(sized)
    kinds = sized.groupBy("source", "short").agg(F.sum("size").alias("words"))
    plan = kinds.join(goal.withColumnRenamed("source", "_s"), kinds["source"].eqNullSafe(F.col("_s"))).drop("_s")
    plan = plan.withColumn("_cap", (F.lit(MAX_COPIES) * F.col("words")).cast("double"))
    plan = plan.withColumn("_w", F.col("words") * F.when(F.col("short"), F.lit(SHORT_WEIGHT)).otherwise(1.0))
    plan = water_fill(plan, ["source"], "_cap", "_w", F.col("target"), "_share")
    copies = F.least(F.when(F.col("words") > 0, F.col("_share") / F.col("words")).otherwise(0.0), F.lit(float(MAX_COPIES)))
    plan = plan.withColumn("certain", F.floor(copies)).withColumn("part", copies - F.floor(copies))
    given = F.sum(F.col("certain") * F.col("words")).over(Window.partitionBy("source"))
    return plan.withColumn("rest", F.col("target") - given).select(
        F.col("source").alias("p_source"), F.col("short").alias("p_short"), "source_size", "target", "certain", "part", "rest")


def _crossing(rows: DataFrame, bucket: str, before) -> DataFrame:
    """Per source, the first bucket with which the words taken in order exceed ``rest``, and the words before it."""
    h = rows.groupBy("source", bucket).agg(F.sum("size").alias("n"), F.first("rest").alias("rest"), F.first(before).alias("b"))
    line = Window.partitionBy("source").orderBy(bucket)  # at most _BUCKETS rows
    h = h.withColumn("upto", F.col("b") + F.sum("n").over(line)).filter(F.col("upto") > F.col("rest"))
    return h.groupBy("source").agg(F.min(F.struct(bucket, (F.col("upto") - F.col("n")).alias("w"))).alias("m")).select(
        F.col("source").alias(f"s_{bucket}"), F.col(f"m.{bucket}").alias(f"at_{bucket}"), F.col("m.w").alias(f"before_{bucket}"))


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words, repeats counted), copies.

    Documents without words have size 0 and take nothing; a null source is a source of its own, the last; rows that
    repeat a doc_id count as documents of their own with equal chances; extra columns are ignored; no rows, no rows.
    The result depends on rows and seed alone.
    """
    sized = stored(sizes(docs), "sizes")
    return _copied(sized, sized, seed).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``docs``, all columns, each document as often as the mix takes it."""
    sized = stored(sizes(docs), "sizes")
    rows = _copied(sized, sizes(docs, row=True), seed).select(F.explode(F.array_repeat("row", F.col("copies").cast("int"))).alias("row"))
    return rows.select("row.*")


def _copied(sized: DataFrame, rows: DataFrame, seed: int) -> DataFrame:
    """``rows`` with their source's numbers and ``copies``; what is planned comes from ``sized``, rows of numbers only."""
    plan = stored(_plan(sized), "mix-plan")  # two rows per source
    drawn = _ranked(sized, plan, seed).filter("z is not null")
    first = stored(_crossing(drawn, "one", F.lit(0.0)), "mix-cut")  # one row per source, as is the next
    near = drawn.join(first, F.col("source").eqNullSafe(F.col("s_one"))).filter("one = at_one")
    second = stored(_crossing(near, "two", F.col("before_one")), "mix-cut")
    rows = _ranked(rows, plan, seed)
    rows = rows.join(first, rows["source"].eqNullSafe(first["s_one"]), "left").join(second, rows["source"].eqNullSafe(second["s_two"]), "left")
    edge = F.coalesce((F.col("one") == F.col("at_one")) & (F.col("two") == F.col("at_two")), F.lit(False))
    inside = F.col("z").isNotNull() & (F.col("at_one").isNull() | (F.col("one") < F.col("at_one"))
                                       | ((F.col("one") == F.col("at_one")) & (F.col("at_two").isNull() | (F.col("two") < F.col("at_two")))))
    line = Window.partitionBy("source").orderBy("z", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.col("before_two") + F.coalesce(F.sum("size").over(line), F.lit(0))
    fine = rows.filter(edge).withColumn("drawn", earlier + F.col("size") / 2 <= F.col("rest"))
    both = rows.filter(~edge).withColumn("drawn", inside).unionByName(fine)
    return both.withColumn("copies", F.col("certain") + F.coalesce(F.col("drawn"), F.lit(False)).cast("long"))


def _ranked(rows: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """``rows`` with their plan, the ranking value z of Pareto sampling in 0..1 (null without a fraction) and its buckets."""
    rows = rows.join(plan, rows["source"].eqNullSafe(plan["p_source"]) & (rows["short"] == plan["p_short"])).drop("p_source", "p_short")
    u = (F.conv(F.substring(F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.lit(str(seed)))), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    odds = u / (1 - u) / (F.col("part") / (1 - F.col("part")))
    rows = rows.withColumn("z", F.when(F.col("part") > 0, odds / (1 + odds)))
    return rows.withColumn("one", F.floor(F.col("z") * _BUCKETS)).withColumn("two", F.floor(F.col("z") * _BUCKETS * _BUCKETS) % _BUCKETS)


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM sized GROUP BY source
), weighted AS (
  SELECT source, source_size, ((k - 1) % 3 + 1)::DOUBLE AS w, 3.0::DOUBLE * source_size AS cap, (sum(source_size) OVER ())::DOUBLE AS total FROM per
), walked AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(w) OVER (ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after FROM weighted
), flagged AS (SELECT *, cap <= 0 OR cap * after <= (total - before) * w AS full_ FROM walked
), goals AS (
  SELECT source, source_size, CASE WHEN full_ THEN cap ELSE w * (total - coalesce(sum(cap) FILTER (full_) OVER (), 0)) / (sum(w) FILTER (NOT full_) OVER ()) END AS target
  FROM flagged
), kinds AS (
  SELECT s.source, size < 64 AS short, any_value(source_size) AS source_size, any_value(target) AS target, sum(size)::BIGINT AS words
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source GROUP BY 1, 2
), kweighted AS (SELECT *, words * CASE WHEN short THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS w, 3.0::DOUBLE * words AS cap FROM kinds
), kwalked AS (
  SELECT *, coalesce(sum(cap) OVER (PARTITION BY source ORDER BY CASE WHEN cap > 0 THEN cap / w ELSE 0 END, short ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(w) OVER (PARTITION BY source ORDER BY CASE WHEN cap > 0 THEN cap / w ELSE 0 END, short ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after FROM kweighted
), kflagged AS (SELECT *, cap <= 0 OR cap * after <= (target - before) * w AS full_ FROM kwalked
), kshare AS (
  SELECT *, CASE WHEN full_ THEN cap ELSE w * (target - coalesce(sum(cap) FILTER (full_) OVER (PARTITION BY source), 0)) / (sum(w) FILTER (NOT full_) OVER (PARTITION BY source)) END AS share FROM kflagged
), copies AS (SELECT *, least(CASE WHEN words > 0 THEN share / words ELSE 0 END, 3.0::DOUBLE) AS c FROM kshare
), plan AS (
  SELECT source, short, source_size, target, floor(c) AS certain, c - floor(c) AS part, target - sum(floor(c) * words) OVER (PARTITION BY source) AS rest FROM copies
), ranked AS (
  SELECT s.doc_id, s.source, s.size, p.source_size, p.target, p.certain, p.part, p.rest,
         (('0x' || substr(md5(s.doc_id::VARCHAR || ':5'), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source AND (s.size < 64) = p.short
), odds AS (SELECT *, CASE WHEN part > 0 THEN u / (1 - u) / (part / (1 - part)) END AS q FROM ranked
), cumulated AS (
  SELECT *, coalesce(sum(CASE WHEN q IS NULL THEN 0 ELSE size END) OVER (PARTITION BY source ORDER BY q / (1 + q) NULLS LAST, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM odds
)
SELECT doc_id, size, source_size, target,
       CAST(size * (certain + CASE WHEN q IS NOT NULL AND earlier + size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken,
       CAST(certain + CASE WHEN q IS NOT NULL AND earlier + size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM cumulated
"""
