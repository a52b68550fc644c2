"""Profiles, correlations, distributions and chart data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.quantiles import quantiles
from ...operators import charts, stats
from .. import sensor_view as v
from .registry import query, sql

SENSORS = ["temperature", "vibration", "pressure", "rpm", "oil_pressure"]


@query("asset_means", sql("readings", """
  SELECT machine_id, count(*) AS n, round(avg(temperature), 6) AS avg_temperature, round(avg(vibration), 6) AS avg_vibration
  FROM readings GROUP BY machine_id"""))
def asset_means(spark, d):
    out = stats.asset_means(v.readings(spark, d), ["temperature", "vibration"])
    return out.withColumns({c: F.round(c, 6) for c in ("avg_temperature", "avg_vibration")})


def _profile_line(c, kind):
    number = kind == "numeric"
    text = f"""SELECT '{c}' AS "column", '{kind}' AS kind, count(*) - count({c}) AS null_count,
      round(100.0::DOUBLE * (count(*) - count({c})) / count(*), 2) AS null_pct, count(DISTINCT {c}) AS unique_count, """
    for name, f in (("mean", "avg({})"), ("std", "stddev_samp({})"), ("min", "min({})"), ("max", "max({})"), ("median", "quantile_cont({}, 0.5)")):
        text += (f"round(CAST({f.format(c)} AS DOUBLE), 4)" if number else "CAST(NULL AS DOUBLE)") + f' AS "{name}", '
    return text + f"round(100 - round(100.0::DOUBLE * (count(*) - count({c})) / count(*), 2), 1) AS quality_score FROM gaps"


@query("profile_columns", sql("gaps", " UNION ALL ".join(
    _profile_line(c, k) for c, k in [("machine_id", "categorical"), ("event_type", "categorical"), ("failure", "numeric"),
                                     *[(s, "numeric") for s in SENSORS]])))
def profile_columns(spark, d):
    df = v.with_gaps(v.readings(spark, d)).select("machine_id", "event_type", "failure", *SENSORS)
    return stats.column_profile(df).drop("first_time", "last_time")


@query("table_score", sql("gaps", """
  SELECT round((3 * 100.0::DOUBLE + 2 * (100 - round(100.0::DOUBLE * count(*) FILTER (temperature IS NULL) / count(*), 2))) / 5, 1) AS quality_score
  FROM gaps"""))
def table_score(spark, d):
    df = v.with_gaps(v.readings(spark, d)).select("machine_id", "event_type", "failure", "temperature", "rpm")
    return stats.table_score(stats.column_profile(df))


@query("top_values", sql("readings", """
  SELECT * FROM (
    SELECT "column", value, n, CAST(row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS INTEGER) AS rank FROM (
      SELECT 'event_type' AS "column", event_type AS value, count(*) AS n FROM readings GROUP BY 2
      UNION ALL SELECT 'machine_id', machine_id, count(*) FROM readings GROUP BY 2))
  WHERE rank <= 5"""))
def top_values(spark, d):
    return stats.top_values(v.readings(spark, d), ["event_type", "machine_id"])


@query("describe_sensors", sql("readings", " UNION ALL ".join(
    f"SELECT '{c}' AS sensor, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c}) AS min, max({c}) AS max FROM readings"
    for c in SENSORS[:4])))
def describe_sensors(spark, d):
    return stats.describe_sensors(v.readings(spark, d), SENSORS[:4]).withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query("rows_per_asset", sql("readings", "SELECT machine_id, count(*) AS n FROM readings GROUP BY 1"))
def rows_per_asset(spark, d):
    return stats.rows_per_asset(v.readings(spark, d))


@query("duplicate_rows", sql("readings", """
  SELECT CAST(sum(n - 1) AS BIGINT) AS dup_rows FROM (SELECT count(*) AS n FROM readings GROUP BY machine_id, event_type)"""))
def duplicate_rows(spark, d):
    return stats.duplicate_counts(v.readings(spark, d), ["machine_id", "event_type"])


def _pairs():
    out = []
    for a in SENSORS:
        for b in SENSORS:
            out.append(f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 6) AS corr FROM gaps")
    out += [f"SELECT '{a}' AS x, 'flat' AS y, CAST(NULL AS DOUBLE) AS corr" for a in [*SENSORS, "flat"]]
    out += [f"SELECT 'flat' AS x, '{a}' AS y, CAST(NULL AS DOUBLE) AS corr" for a in SENSORS]
    return " UNION ALL ".join(out)


@query("corr_matrix", sql("gaps", _pairs()))
def corr_matrix(spark, d):
    df = v.with_gaps(v.readings(spark, d)).withColumn("flat", F.lit(1.0))
    return stats.correlation_matrix(df, [*SENSORS, "flat"]).withColumn("corr", F.round("corr", 6))


@query("slope_corr", sql("gaps", """
  SELECT 'temperature' AS x, 'vibration' AS y, regr_count(vibration, temperature)::BIGINT AS n, round(regr_slope(vibration, temperature), 9) AS slope,
         round(corr(vibration, temperature), 6) AS corr, CASE WHEN regr_slope(vibration, temperature) > 0 THEN 'rising' ELSE 'falling' END AS direction
  FROM gaps"""))
def slope_corr(spark, d):
    out = stats.slope_reading(v.with_gaps(v.readings(spark, d)), "temperature", "vibration")
    return out.withColumns({"slope": F.round("slope", 9), "corr": F.round("corr", 6)})


@query("group_gap", sql("readings", """
  SELECT arg_max(event_type, m) AS high, round(max(m), 6) AS high_mean, arg_min(event_type, m) AS low, round(min(m), 6) AS low_mean,
         round(max(m) - min(m), 6) AS gap, count(*) AS groups
  FROM (SELECT event_type, avg(vibration) AS m FROM readings GROUP BY 1)"""))
def group_gap(spark, d):
    out = stats.group_gap(v.readings(spark, d), "event_type", "vibration")
    return out.withColumns({c: F.round(c, 6) for c in ("high_mean", "low_mean", "gap")})


@query("histogram", sql("readings", """
  SELECT machine_id, bin, round(lo + bin * w, 6) AS bin_start, round(lo + (bin + 1) * w, 6) AS bin_end, n FROM (
    SELECT machine_id, CAST(least(29, floor((vibration - lo) / w)) AS INTEGER) AS bin, lo, w, count(*) AS n
    FROM readings, (SELECT min(vibration) AS lo, (max(vibration) - min(vibration)) / 30 AS w FROM readings) GROUP BY ALL)"""))
def histogram(spark, d):
    out = stats.histogram(v.readings(spark, d), "vibration", by="machine_id")
    return out.withColumns({c: F.round(c, 6) for c in ("bin_start", "bin_end")})


_BOX = """SELECT machine_id, quantile_cont(vibration, 0.25) AS q1, quantile_cont(vibration, 0.5) AS median,
  quantile_cont(vibration, 0.75) AS q3 FROM readings GROUP BY 1"""
_INSIDE = "vibration BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)"


@query("box", sql("readings", f"""
  SELECT machine_id, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
         round(min(vibration) FILTER ({_INSIDE}), 6) AS whisker_low, round(max(vibration) FILTER ({_INSIDE}), 6) AS whisker_high,
         count(*) FILTER (NOT ({_INSIDE})) AS n_outliers
  FROM readings JOIN b USING (machine_id) GROUP BY machine_id, q1, median, q3""", b=_BOX))
def box(spark, d):
    out = stats.box_summary(v.readings(spark, d), "vibration")
    return out.withColumns({c: F.round(c, 6) for c in ("q1", "median", "q3", "whisker_low", "whisker_high")})


@query("quartiles_bracket", sql("readings", """
  SELECT machine_id, round(quantile_cont(vibration, 0.25), 6) AS q1, round(quantile_cont(vibration, 0.5), 6) AS median,
         round(quantile_cont(vibration, 0.75), 6) AS q3 FROM readings GROUP BY 1"""))
def quartiles_bracket(spark, d):
    """The way of large groups (bracket the ranks, count inside the bracket), on every table."""
    out = quantiles(v.readings(spark, d), ["vibration"], [0.25, 0.5, 0.75], ["machine_id"], method="bracket")
    return out.select("machine_id", *[F.round(F.col("vibration")[i], 6).alias(n) for i, n in enumerate(("q1", "median", "q3"))])


@query("box_outliers", sql("readings", f"""
  SELECT event_id FROM readings JOIN b USING (machine_id) WHERE NOT ({_INSIDE})""", b=_BOX))
def box_outliers(spark, d):
    return stats.box_outliers(v.readings(spark, d), "vibration").select("event_id")


_PIVOT = ["M-0008", "M-0041", "M-0089"]


@query("pivot_latest", sql("readings", "SELECT strftime(h, '%Y-%m-%d %H') AS h, " + ", ".join(
    f"""arg_max(temperature, event_id) FILTER (machine_id = '{a}') AS "{a}" """ for a in _PIVOT
) + """ FROM (SELECT *, date_trunc('hour', "timestamp") AS h FROM readings WHERE machine_id IN ('M-0008', 'M-0041', 'M-0089')) GROUP BY h"""))
def pivot_latest(spark, d):
    df = v.readings(spark, d).withColumn("timestamp", F.date_trunc("hour", "timestamp"))
    out = stats.pivot_latest(df, "temperature", _PIVOT)
    return out.select(F.date_format("timestamp", "yyyy-MM-dd HH").alias("h"), *[F.col(f"`{a}`") for a in _PIVOT])


@query("latest_by_time", sql("readings", """
  SELECT strftime(h, '%Y-%m-%d %H') AS h, machine_id, arg_max(temperature, event_id) AS temperature
  FROM (SELECT *, date_trunc('hour', "timestamp") AS h FROM readings) GROUP BY h, machine_id"""))
def latest_by_time(spark, d):
    df = v.readings(spark, d).withColumn("timestamp", F.date_trunc("hour", "timestamp"))
    out = stats.latest_by_time(df, "temperature")
    return out.select(F.date_format("timestamp", "yyyy-MM-dd HH").alias("h"), "machine_id", "temperature")


# ---------------------------------------------------------------- charts
@query("sensor_over_time", sql("readings", """
  SELECT machine_id, strftime(date_trunc('day', "timestamp"), '%Y-%m-%d') AS day, round(avg(temperature), 6) AS temperature
  FROM readings GROUP BY 1, 2"""))
def sensor_over_time(spark, d):
    out = charts.sensor_over_time(v.readings(spark, d), "temperature", every="1 day")
    return out.select("machine_id", F.date_format("timestamp", "yyyy-MM-dd").alias("day"), F.round("temperature", 6).alias("temperature"))


@query("anomaly_timeline", sql("scored", "SELECT event_id, vibration, anomaly_score FROM scored WHERE is_anomaly"))
def anomaly_timeline(spark, d):
    out = charts.anomaly_timeline(v.scored(v.readings(spark, d)), "vibration")
    return out.select("event_id", "vibration", "anomaly_score")


@query("anomaly_scatter", sql("scored", """
  SELECT event_id, temperature, vibration, CASE WHEN is_anomaly THEN 'Anomaly' ELSE 'Normal' END AS anomaly FROM scored"""))
def anomaly_scatter(spark, d):
    return charts.anomaly_scatter(v.scored(v.readings(spark, d)), "temperature", "vibration").drop("machine_id")


@query("risk_by_asset", sql("readings", """
  SELECT machine_id, CAST(greatest(1, round_even(rul, 0)) AS INTEGER) AS predicted_rul_days,
         CASE WHEN rul <= 7 THEN 'High' WHEN rul <= 14 THEN 'Medium' ELSE 'Low' END AS risk_level
  FROM (SELECT machine_id, CAST(arg_max(event_id % 30, ("timestamp", event_id)) AS DOUBLE) AS rul FROM readings GROUP BY 1)"""))
def risk_by_asset(spark, d):
    df = v.readings(spark, d).withColumn("failure_within_days", (F.col("event_id") % 30).cast("double"))
    return charts.risk_by_asset(df)
