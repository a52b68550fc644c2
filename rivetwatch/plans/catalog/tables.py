"""Slices, joins, unions, files and SQL text."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ...operators import joins, stats
from ...operators.insights import high_risk
from ...operators.rul import proxy_predictions
from ...sources import slices
from .. import sensor_view as v
from ..sql import run_sql, slice_sql
from .registry import query, sql

AS_OF = datetime(2024, 1, 31)


# ---------------------------------------------------------------- slices
@query("slice_last_n", sql("readings", """
  SELECT event_id FROM readings ORDER BY "timestamp" DESC, event_id DESC LIMIT 500"""))
def slice_last_n(spark, d):
    return slices.slice_table(v.readings(spark, d), "last_n_rows", n=500).select("event_id")


@query("slice_days", sql("readings", """
  SELECT event_id FROM readings WHERE "timestamp" >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY"""))
def slice_days(spark, d):
    return slices.last_n_days(v.readings(spark, d), 7, AS_OF).select("event_id")


@query("slice_machine", sql("readings", "SELECT event_id, temperature FROM readings WHERE machine_id = 'M-0008'"))
def slice_machine(spark, d):
    return slices.filter_asset(v.readings(spark, d), "M-0008").select("event_id", "temperature")


@query("slice_asset", sql("readings", """
  SELECT event_id FROM readings WHERE machine_id = 'M-0041' ORDER BY "timestamp" DESC, event_id DESC LIMIT 50"""))
def slice_asset(spark, d):
    df = v.readings(spark, d).withColumnRenamed("machine_id", "asset_id")
    return slices.slice_table(df, "filter_asset_id", asset_id="M-0041", n=50).select("event_id")


@query("slice_range", sql("readings", """
  SELECT event_id FROM readings WHERE "timestamp" >= TIMESTAMP '2024-01-10' AND "timestamp" < TIMESTAMP '2024-01-12'"""))
def slice_range(spark, d):
    return slices.date_range(v.readings(spark, d), "2024-01-10", "2024-01-12").select("event_id")


@query("sample_hash", sql("readings", """
  SELECT event_id FROM readings WHERE ('0x' || substr(md5('42:' || CAST(event_id AS VARCHAR)), 1, 13))::BIGINT % 10000 < 500"""))
def sample_hash(spark, d):
    return slices.sample_percent(v.readings(spark, d), 5.0, key="event_id").select("event_id")


@query("failure_focus", sql("life", """
  SELECT event_id FROM life WHERE failure = 1 OR failure_within_days <= 3"""))
def failure_focus(spark, d):
    df = v.with_life(v.readings(spark, d))
    return slices.failure_focus(df, 3, rul="failure_within_days").select("event_id")


@query("page_rows", sql("readings", """
  SELECT event_id FROM readings ORDER BY "timestamp", event_id LIMIT 20 OFFSET 40"""))
def page_rows(spark, d):
    return slices.page(v.readings(spark, d), 40, 20).select("event_id")


@query("slice_sql", sql("readings", """
  SELECT machine_id, max(temperature) AS hottest FROM readings WHERE temperature > 100 GROUP BY machine_id"""))
def slice_text(spark, d):
    text = "SELECT machine_id, max(temperature) AS hottest FROM {source} WHERE temperature > 100 GROUP BY machine_id"
    return slice_sql(spark, text, v.readings(spark, d))


# ---------------------------------------------------------------- joins
def _machines(spark, d):
    """Sensor means per asset; many customers have no readings, so one-sided joins differ."""
    return stats.asset_means(v.readings(spark, d), ["temperature"])


_MACHINES = """SELECT machine_id, count(*) AS n, avg(temperature) AS avg_temperature FROM readings GROUP BY 1"""


@query("join_inner", sql("readings maintenance", """
  SELECT event_id, work_order, r.event_type AS event_type_l, m.event_type AS event_type_r
  FROM readings r JOIN maintenance m USING (machine_id)"""))
def join_inner(spark, d):
    out = joins.join_two(v.readings(spark, d), v.maintenance(spark, d), "inner", ["machine_id"])
    return out.select("event_id", "work_order", "event_type_l", "event_type_r")


def _sided(how):
    def run(spark, d):
        out = joins.join_two(_machines(spark, d), v.costs(spark, d), how, ["machine_id"])
        return out.select("machine_id", F.col("n").cast("double").alias("n"), F.round("downtime_cost", 4).alias("downtime_cost"))

    return run


for _how, _words in (("left", "LEFT"), ("right", "RIGHT"), ("outer", "FULL OUTER")):
    query(f"join_{'full' if _how == 'outer' else _how}", sql("readings costs", f"""
      SELECT machine_id, CAST(n AS DOUBLE) AS n, round(downtime_cost, 4) AS downtime_cost
      FROM machines {_words} JOIN costs c USING (machine_id)""",
      machines=_MACHINES))(_sided(_how))


@query("join_two_names", sql("readings costs", """
  SELECT m.machine_id, c.machine_id AS asset, m.n FROM machines m JOIN costs c ON m.machine_id = c.machine_id""", machines=_MACHINES))
def join_two_names(spark, d):
    costs = v.costs(spark, d).withColumnRenamed("machine_id", "asset")
    out = joins.join_two(_machines(spark, d), costs, "inner", left_on="machine_id", right_on="asset")
    return out.select("machine_id", "asset", "n")


@query("join_chain", sql("readings maintenance costs", """
  SELECT machine_id, n, CAST(work_order AS DOUBLE) AS work_order, segment FROM machines LEFT JOIN maintenance USING (machine_id) JOIN costs USING (machine_id)""",
  machines=_MACHINES))
def join_chain(spark, d):
    tables = {"sensors": _machines(spark, d), "maintenance": v.maintenance(spark, d), "costs": v.costs(spark, d)}
    steps = [
        {"left": "sensors", "right": "maintenance", "how": "left", "on": ["machine_id"]},
        {"left": "_result", "right": "costs", "how": "inner"},
    ]
    return joins.join_many(tables, steps).select("machine_id", "n", F.col("work_order").cast("double").alias("work_order"), "segment")


@query("join_report", sql("readings costs", """
  SELECT 'left' AS how, 'machine_id' AS join_keys, (SELECT count(*) FROM machines) AS left_rows, (SELECT count(*) FROM costs) AS right_rows,
         (SELECT count(*) FROM machines LEFT JOIN costs USING (machine_id)) AS result_rows""", machines=_MACHINES))
def join_report(spark, d):
    left, right = _machines(spark, d), v.costs(spark, d)
    return joins.join_report(left, right, joins.join_two(left, right, "left"), "left", ["machine_id"])


@query("join_null_safe", sql("readings", """
  SELECT a.event_type, a.n, b.n AS n_b FROM a JOIN b ON a.event_type IS NOT DISTINCT FROM b.event_type""",
  a="SELECT nullif(event_type, 'view') AS event_type, count(*) AS n FROM readings GROUP BY 1",
  b="SELECT nullif(event_type, 'view') AS event_type, count(temperature) AS n FROM readings GROUP BY 1"))
def join_null_safe(spark, d):
    def counts(df, what):
        return df.groupBy(F.nullif("event_type", F.lit("view")).alias("event_type")).agg(F.count(what).alias("n"))

    df = v.readings(spark, d)
    out = joins.join_two(counts(df, F.lit(1)), counts(df, "temperature"), "inner", ["event_type"], suffixes=("", "_b"), null_safe=True)
    return out.select("event_type", "n", "n_b")


@query("asset_spine", sql("readings costs", """
  SELECT machine_id FROM readings UNION SELECT machine_id FROM costs"""))
def spine(spark, d):
    return joins.asset_spine([v.readings(spark, d), v.costs(spark, d)])


@query("attach_predictions", sql("readings preds", """
  SELECT event_id, predicted_rul_days, risk_level FROM readings LEFT JOIN preds USING (machine_id)"""))
def attach(spark, d):
    df = v.readings(spark, d)
    return joins.attach_predictions(df, proxy_predictions(df)).select("event_id", "predicted_rul_days", "risk_level")


# ---------------------------------------------------------------- sets, top-k
@query("append_rows", sql("readings maintenance", """
  SELECT machine_id, event_type, CAST(event_id AS DOUBLE) AS event_id, CAST(work_order AS DOUBLE) AS work_order FROM (SELECT machine_id, event_type, event_id, NULL AS work_order FROM readings
  UNION ALL SELECT machine_id, event_type, NULL, work_order FROM maintenance)"""))
def append_rows(spark, d):
    a = v.readings(spark, d).select("machine_id", "event_type", "event_id")
    b = v.maintenance(spark, d).select("machine_id", "event_type", "work_order")
    return stats.append(a, b).withColumns({c: F.col(c).cast("double") for c in ("event_id", "work_order")})


@query("flagged_first", sql("scored", """
  SELECT event_id FROM (
    SELECT event_id FROM (SELECT event_id, is_anomaly, row_number() OVER (PARTITION BY is_anomaly ORDER BY "timestamp" DESC, event_id DESC) AS rn
                          FROM scored) x
    WHERE NOT is_anomaly OR rn <= 200
    ORDER BY is_anomaly DESC, rn LIMIT 400)"""))
def flagged_first(spark, d):
    return stats.flagged_first(v.scored(v.readings(spark, d)), "is_anomaly").select("event_id")


@query("high_risk_list", sql("preds", "SELECT machine_id, predicted_rul_days FROM preds WHERE risk_level = 'High'"))
def high_risk_list(spark, d):
    return high_risk(proxy_predictions(v.readings(spark, d))).select("machine_id", "predicted_rul_days")


# ---------------------------------------------------------------- SQL text
@query("sql_lab", sql("life", """
  SELECT machine_id, count(*) AS n, round(avg(failure_within_days), 6) AS avg_rul,
         row_number() OVER (ORDER BY count(*) DESC, machine_id) AS place
  FROM life WHERE event_type <> 'DROP' GROUP BY machine_id"""))
def sql_lab(spark, d):
    text = """
      SELECT machine_id, count(*) AS n, round(avg(failure_within_days), 6) AS avg_rul,
             row_number() OVER (ORDER BY count(*) DESC, machine_id) AS place
      FROM sensor_readings WHERE event_type <> 'DROP' GROUP BY machine_id"""
    return run_sql(spark, text, {"sensor readings": v.with_life(v.readings(spark, d))})
