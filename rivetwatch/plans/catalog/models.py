"""Forest, remaining-life model, and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import charts, iforest, insights, retrieval, rul
from ...sources.readers import spread_input
from .. import sensor_view as v
from .fleet import INSPECT_SQL
from .registry import query, sql


# ---------------------------------------------------------------- isolation forest
@query("iforest")
def forest(spark, d):
    df = v.readings(spark, d, spread=True)
    _, scored = iforest.fit_annotate(df)
    return scored.select("event_id", F.round("anomaly_score", 9).alias("anomaly_score"), "is_anomaly")


@query("iforest_summary")
def forest_summary(spark, d):
    df = v.readings(spark, d, spread=True)
    return iforest.anomaly_summary(iforest.fit_annotate(df)[1])


@query("iforest_timeline")
def forest_timeline(spark, d):
    df = v.readings(spark, d, spread=True)
    return charts.anomaly_timeline(iforest.fit_annotate(df)[1], "vibration").drop("timestamp")


_CANDIDATES = (0.02, 0.05, 0.08, 0.11, 0.15)


@query("tune_contamination", sql("scored", " UNION ALL ".join(f"""
  SELECT {c}::DOUBLE AS contamination, round(avg(anomaly_score) FILTER (anomaly_score >= bar) - avg(anomaly_score) FILTER (anomaly_score < bar), 6) AS separation
  FROM scored, (SELECT quantile_cont(anomaly_score, {round(1 - c, 2)}) AS bar FROM scored)""" for c in _CANDIDATES)))
def tune_contamination(spark, d):
    out = iforest.tune_contamination(v.scored(v.readings(spark, d)), list(_CANDIDATES))
    return out.withColumn("separation", F.round("separation", 6))


# ---------------------------------------------------------------- remaining life
def _rul(spark, d):
    featured = rul.rul_features(v.with_life(v.readings(spark, d)))
    return featured, rul.fit_rul(featured)


@query("rul_latest")
def rul_latest(spark, d):
    featured, model = _rul(spark, d)
    return rul.predict_latest(model, featured)


@query("rul_importance")
def rul_importance(spark, d):
    _, model = _rul(spark, d)
    return model.importances(spark).limit(10)


@query("rul_metrics")
def rul_metrics(spark, d):
    _, model = _rul(spark, d)
    return spark.createDataFrame(
        [(model.label_source, *[model.metrics[m] for m in ("mae", "rmse", "r2")])], "label_source string, mae double, rmse double, r2 double"
    )


@query("tune_rul")
def tune_rul(spark, d):
    """Six trials with few trees, so that the check stays short; the defaults are 20 trials with up to 250 trees."""
    featured = rul.rul_features(v.with_life(v.readings(spark, d)))
    return rul.search_rows(spark, rul.tune_rul(featured, trials=6, folds=2, max_trees=9))


# ---------------------------------------------------------------- retrieval
_WORDS = r"regexp_extract_all(lower(text), '([\p{L}\p{N}_]{2,})', 1)"


def _grams(source, key):
    return f"""SELECT key, term, count(*) AS tf FROM (
      SELECT {key} AS key, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))])) AS term FROM (SELECT {key}, {_WORDS} AS w FROM {source}))
      GROUP BY 1, 2"""


@query("tfidf_topk", sql("", """
  SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM (
      SELECT q.key AS query_id, d.key AS doc_id, sum(q.w * d.w) / (any_value(qn.n) * any_value(dn.n)) AS score
      FROM q JOIN d USING (term) JOIN qn ON qn.key = q.key JOIN dn ON dn.key = d.key GROUP BY 1, 2) WHERE score > 0)
  WHERE rank <= 6""",
  dt=_grams("documents", "doc_id"), qt=_grams("benchmark", "item_id"),
  vocab="""SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf, sum(tf) AS total FROM dt GROUP BY term
           ORDER BY total DESC, term LIMIT 4096""",
  d="SELECT key, term, tf * idf AS w FROM dt JOIN vocab USING (term)", q="SELECT key, term, tf * idf AS w FROM qt JOIN vocab USING (term)",
  dn="SELECT key, sqrt(sum(w * w)) AS n FROM d GROUP BY 1", qn="SELECT key, sqrt(sum(w * w)) AS n FROM q GROUP BY 1"))
def tfidf_topk(spark, d):
    queries = v.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    out = retrieval.tfidf_top_k(spread_input(v.table(spark, d, "documents").select("doc_id", "text")), queries)
    return out.withColumn("score", F.round("score", 6))


@query("keyword", sql("", """
  SELECT query_id, doc_id, CAST(score AS DOUBLE) AS score, CAST(rank AS INTEGER) AS rank, 'keyword' AS source FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
      SELECT q.k AS query_id, d.k AS doc_id, count(*) AS score FROM q JOIN d USING (token) GROUP BY 1, 2)) WHERE rank <= 6""",
  d="SELECT DISTINCT doc_id AS k, unnest(regexp_extract_all(lower(text), '([a-z0-9_.]+)', 1)) AS token FROM documents",
  q="SELECT DISTINCT item_id AS k, unnest(regexp_extract_all(lower(text), '([a-z0-9_.]+)', 1)) AS token FROM benchmark"))
def keyword(spark, d):
    queries = v.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return retrieval.keyword_top_k(spread_input(v.table(spark, d, "documents").select("doc_id", "text")), queries)


@query("row_documents", sql("gaps", """
  SELECT event_id AS doc_id, concat_ws(' | ', 'row_id=' || CAST(event_id AS VARCHAR), 'machine_id=' || machine_id, 'event_type=' || event_type,
         'temperature=' || CAST(temperature AS VARCHAR), 'failure=' || CAST(failure AS VARCHAR)) AS text FROM gaps"""))
def row_documents(spark, d):
    return retrieval.row_documents(v.with_gaps(v.readings(spark, d)), "event_id", ["machine_id", "event_type", "temperature", "failure"])


@query("brief_documents", sql("ranked preds", f"""
  SELECT 'RUL_PRED machine_id=' || machine_id || ' predicted_rul_days=' || CAST(predicted_rul_days AS VARCHAR) || ' risk_level=' || risk_level
    || ' is_proxy=true label_source=synthetic_degradation_proxy message=' || machine_id || ': ' || risk_level || ' risk, about '
    || CAST(predicted_rul_days AS VARCHAR) || ' days by wear. Estimated from wear; no date of failure is known.' AS text FROM preds
  UNION ALL
  SELECT 'ASSET_RANK rank=' || CAST(rank AS VARCHAR) || ' machine_id=' || machine_id || ' risk_level=' || risk_level || ' predicted_rul_days='
    || CAST(predicted_rul_days AS VARCHAR) || ' mean_anomaly_score=' || CAST(mean_anomaly_score AS VARCHAR) || ' anomaly_count='
    || CAST(anomaly_count AS VARCHAR) || ' why=' || array_to_string(why, '; ') FROM ranked
  UNION ALL
  SELECT 'INSPECT machine_id=' || machine_id || ' ' || message FROM ({INSPECT_SQL})"""))
def brief_documents(spark, d):
    from .fleet import _Fleet

    run = _Fleet(spark, d)
    return retrieval.brief_documents(run.ranked, run.preds, insights.inspect_this_week(run.ranked, most=None))
