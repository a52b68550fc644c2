"""Cleaning and window operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import clean, joins, mapping
from ...operators.charts import rolling_trend
from ...operators.rul import rul_features
from ...operators.series import add_windowed, forward_fill, latest_per_asset, profile_series, rolling_mean, rolling_std, step
from ...operators.whole import add_windowed_whole, forward_fill_whole, running_whole
from .. import sensor_view as v
from .registry import query, sql

CORE = ["temperature", "vibration", "pressure", "rpm"]


def _rounded(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


def _gaps(spark, d):
    return v.with_gaps(v.readings(spark, d))


# ---------------------------------------------------------------- shape and types
@query("clean_sentinel", sql("text_cells", """
  SELECT event_id, CASE WHEN temperature NOT IN ('', 'NA', 'N/A', 'null', 'NULL', 'None', '-', '--') THEN temperature END AS temperature,
         CASE WHEN vibration NOT IN ('', 'NA', 'N/A', 'null', 'NULL', 'None', '-', '--') THEN vibration END IS NULL AS no_vibration,
         CASE WHEN event_type NOT IN ('', 'NA', 'N/A', 'null', 'NULL', 'None', '-', '--') THEN event_type END AS event_type
  FROM text_cells"""))
def clean_sentinel(spark, d):
    out = clean.fuse_sentinels(v.as_text(v.readings(spark, d)))
    return out.select("event_id", "temperature", F.col("vibration").isNull().alias("no_vibration"), "event_type")


@query("cast_numeric", sql("text_cells", """
  SELECT event_id, TRY_CAST(temperature AS DOUBLE) AS temperature, round(TRY_CAST(vibration AS DOUBLE), 6) AS vibration,
         strftime(TRY_CAST("timestamp" AS TIMESTAMP), '%Y-%m-%d %H:%M:%S.%f') AS read_at, event_type
  FROM text_cells"""))
def cast_numeric(spark, d):
    df = v.as_text(v.readings(spark, d))
    out = clean.apply_types(df, clean.plan_types(clean.fuse_sentinels(df)))
    return out.select(
        "event_id", "temperature", F.round("vibration", 6).alias("vibration"),
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("read_at"), "event_type",
    )


@query("drop_bad_timestamps", sql("text_cells", """
  SELECT event_id, trim(machine_id) AS machine_id FROM text_cells WHERE TRY_CAST("timestamp" AS TIMESTAMP) IS NOT NULL"""))
def drop_bad_timestamps(spark, d):
    out = clean.trim_asset_ids(clean.drop_bad_timestamps(v.as_text(v.readings(spark, d))))
    return out.select("event_id", "machine_id")


@query("dedupe_rows", sql("readings", """
  SELECT DISTINCT machine_id, temperature, event_type FROM readings"""))
def dedupe_rows(spark, d):
    return clean.drop_duplicate_rows(v.readings(spark, d).select("machine_id", "temperature", "event_type"))


@query("drop_empty_rows", sql("gaps", """
  SELECT temperature, pressure FROM gaps WHERE temperature IS NOT NULL OR pressure IS NOT NULL"""))
def drop_empty_rows(spark, d):
    return clean.drop_empty_rows(_gaps(spark, d).select("temperature", "pressure"))


@query("map_headers", sql("readings", """
  SELECT event_id, machine_id, temperature, vibration, pressure FROM readings"""))
def map_headers(spark, d):
    messy = v.readings(spark, d).select(
        "event_id", F.col("machine_id").alias("Asset ID"), F.col("temperature").alias("Temp C"),
        F.col("vibration").alias("RMS-Vib"), F.col("pressure").alias("press_psi"),
    )
    out = mapping.apply_mapping(messy, mapping.suggest_mapping(messy.columns))
    return out.select("event_id", "machine_id", "temperature", "vibration", "pressure")


# Four detect columns and the keyword "pump" (in pump_fillage) speak for the plant pack, and so on.
@query("pack_scores", sql("engine", """
  SELECT * FROM (VALUES
    ('plant_rotating', 12.0::DOUBLE + 1.5 + CASE WHEN (SELECT bool_or(machine_id LIKE 'M-%') FROM engine) THEN 2 ELSE 0 END),
    ('aviation_uav_piston', 6.0::DOUBLE + 3.0),
    ('automotive_powertrain', 6.0::DOUBLE + 1.5),
    ('oil_srp', 9.0::DOUBLE + 3.0)) AS t(pack_id, score)"""))
def pack_scores(spark, d):
    return mapping.pack_scores(v.engine(v.readings(spark, d))).select("pack_id", "score")


# ---------------------------------------------------------------- filling and capping
@query("ffill", sql("filled", "SELECT event_id, temperature, vibration, pressure, rpm FROM filled"))
def ffill(spark, d):
    return forward_fill(_gaps(spark, d), CORE).select("event_id", *CORE)


@query("median_fill", sql("gaps", """
  SELECT event_id, coalesce(temperature, (SELECT quantile_cont(temperature, 0.5) FROM gaps)) AS temperature,
         round(coalesce(vibration, (SELECT quantile_cont(vibration, 0.5) FROM gaps)), 6) AS vibration
  FROM gaps"""))
def median_fill(spark, d):
    out = clean.median_fill(_gaps(spark, d), ["temperature", "vibration"])
    return _rounded(out, "vibration").select("event_id", "temperature", "vibration")


_CAP = """
  SELECT event_id, round(least(greatest(temperature, t1 - 1.5 * (t3 - t1)), t3 + 1.5 * (t3 - t1)), 6) AS temperature,
         round(least(greatest(vibration, v1 - 1.5 * (v3 - v1)), v3 + 1.5 * (v3 - v1)), 6) AS vibration
  FROM {0}, (SELECT quantile_cont(temperature, 0.25) AS t1, quantile_cont(temperature, 0.75) AS t3,
                    quantile_cont(vibration, 0.25) AS v1, quantile_cont(vibration, 0.75) AS v3 FROM {0})"""


@query("iqr_cap", sql("readings", _CAP.format("readings")))
def iqr_cap(spark, d):
    out = clean.winsorize(v.readings(spark, d), ["temperature", "vibration"])
    return _rounded(out, "temperature", "vibration").select("event_id", "temperature", "vibration")


_FULL = """SELECT * REPLACE (coalesce(temperature, (SELECT quantile_cont(temperature, 0.5) FROM filled)) AS temperature,
  coalesce(vibration, (SELECT quantile_cont(vibration, 0.5) FROM filled)) AS vibration) FROM filled"""


@query("clean_sensors", sql("filled", _CAP.format("complete"), complete=_FULL))
def clean_sensors(spark, d):
    df = _gaps(spark, d)
    out = clean.clean_sensor_data(df, profile=profile_series(df))
    return _rounded(out, "temperature", "vibration").select("event_id", "temperature", "vibration")


@query("clean_wide", sql("gaps", """
  SELECT event_id, round(least(greatest(o, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)), 6) AS oil_pressure,
         round(least(greatest(x, x1 - 1.5 * (x3 - x1)), x3 + 1.5 * (x3 - x1)), 6) AS vibration
  FROM full_rows, (SELECT quantile_cont(o, 0.25) AS q1, quantile_cont(o, 0.75) AS q3,
                          quantile_cont(x, 0.25) AS x1, quantile_cont(x, 0.75) AS x3 FROM full_rows)""",
    full_rows="""SELECT event_id, coalesce(oil_pressure, (SELECT quantile_cont(oil_pressure, 0.5) FROM gaps)) AS o,
      coalesce(vibration, (SELECT quantile_cont(vibration, 0.5) FROM gaps)) AS x FROM gaps"""))
def clean_wide(spark, d):
    out = clean.clean_wide(_gaps(spark, d))
    return _rounded(out, "oil_pressure", "vibration").select("event_id", "oil_pressure", "vibration")


@query("regr_impute", sql("gaps", """
  SELECT g.event_id, round(coalesce(g.temperature, CASE WHEN f.n >= 5 THEN f.a * g.x + f.b END,
                                    (SELECT quantile_cont(temperature, 0.5) FROM gaps)), 6) AS temperature
  FROM timed g JOIN (SELECT machine_id, count(temperature) AS n, regr_slope(temperature, x) AS a, regr_intercept(temperature, x) AS b
                     FROM timed GROUP BY 1) f USING (machine_id)""",
    timed="""SELECT *, (epoch_us("timestamp") - min(epoch_us("timestamp")) OVER (PARTITION BY machine_id)) / 3.6e9 AS x FROM gaps"""))
def regr_impute(spark, d):
    out = clean.regression_impute(_gaps(spark, d), ["temperature"])
    return out.select("event_id", F.round("temperature", 6).alias("temperature"))


@query("mode_fill", sql("readings", """
  SELECT event_id, coalesce(CASE WHEN event_id % 17 <> 0 THEN event_type END, (
    SELECT event_type FROM readings WHERE event_id % 17 <> 0 GROUP BY 1 ORDER BY count(*) DESC, event_type LIMIT 1)) AS event_type,
    'Unknown' AS nothing
  FROM readings"""))
def mode_fill(spark, d):
    df = v.readings(spark, d).select(
        "event_id", F.when(F.col("event_id") % 17 != 0, F.col("event_type")).alias("event_type"),
        F.lit(None).cast("string").alias("nothing"),
    )
    return clean.mode_impute(df, ["event_type", "nothing"])


@query("quantile_bin", sql("readings", """
  SELECT event_id, CAST(greatest(len(list_filter(edges, lambda e: e < vibration)), 1) - 1 AS INTEGER) AS vibration_bin_idx
  FROM readings, (SELECT list_sort(list_distinct(quantile_cont(vibration, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS edges FROM readings)"""))
def quantile_bin(spark, d):
    return clean.quantile_bin(v.readings(spark, d), ["vibration"]).select("event_id", "vibration_bin_idx")


@query("lab_bin", sql("readings", """
  SELECT temperature_quartile, count(*) AS n FROM (
    SELECT '(' || printf('%.3f', edges[i + 1]) || ', ' || printf('%.3f', edges[i + 2]) || ']' AS temperature_quartile FROM (
      SELECT edges, CAST(greatest(len(list_filter(edges, lambda e: e < temperature)), 1) - 1 AS INTEGER) AS i
      FROM readings, (SELECT list_sort(list_distinct(quantile_cont(temperature, [0.0, 0.25, 0.5, 0.75, 1.0]))) AS edges FROM readings)))
  GROUP BY 1"""))
def lab_bin(spark, d):
    out = clean.quantile_bin(v.readings(spark, d), ["temperature"], q=4, suffix="_quartile")
    return out.groupBy("temperature_quartile").agg(F.count(F.lit(1)).alias("n"))


@query("znorm", sql("readings", """
  SELECT event_id, round((vibration - mu) / (sd + 1e-9), 6) AS vibration_z
  FROM readings, (SELECT avg(vibration) AS mu, stddev_samp(vibration) AS sd FROM readings)"""))
def znorm(spark, d):
    return clean.z_normalize(v.readings(spark, d), ["vibration"]).select("event_id", F.round("vibration_z", 6).alias("vibration_z"))


@query("clean_log", sql("gaps", """
  SELECT * FROM (
    SELECT 'median fill' AS step, 'temperature' AS "column", count(*) FILTER (temperature IS NULL) AS n FROM gaps
    UNION ALL SELECT 'median fill', 'vibration', count(*) FILTER (vibration IS NULL) FROM gaps
    UNION ALL SELECT 'iqr cap', 'vibration', (SELECT count(*) FROM gaps, q WHERE vibration < q1 - 1.5 * (q3 - q1) OR vibration > q3 + 1.5 * (q3 - q1)))
  WHERE n > 0""", q="SELECT quantile_cont(vibration, 0.25) AS q1, quantile_cont(vibration, 0.75) AS q3 FROM gaps"))
def clean_log(spark, d):
    return clean.clean_log(_gaps(spark, d), ["temperature", "vibration"])


# ---------------------------------------------------------------- windows
_SERIES = 'PARTITION BY machine_id ORDER BY "timestamp", event_id'


@query("smooth_clean", sql("readings", """
  SELECT event_id, round(CASE w WHEN 2 THEN m2 WHEN 3 THEN m3 WHEN 4 THEN m4 ELSE m5 END, 6) AS temperature_smooth FROM (
    SELECT event_id, least(5, greatest(2, count(*) OVER (PARTITION BY machine_id) // 10)) AS w, """
    + ", ".join(f"avg(temperature) OVER ({_SERIES} ROWS {n - 1} PRECEDING) AS m{n}" for n in range(2, 6)) + " FROM readings)"))
def smooth_clean(spark, d):
    return clean.smooth(v.readings(spark, d), ["temperature"]).select("event_id", F.round("temperature_smooth", 6).alias("temperature_smooth"))


_WIDTHS = " ".join(f"WHEN {n} THEN avg(vibration) OVER ({_SERIES} ROWS {n - 1} PRECEDING)" for n in range(3, 13))


@query("smooth_lab", sql("readings", f"""
  SELECT event_id, round(CASE w {_WIDTHS} END, 6) AS vibration_smoothed
  FROM readings JOIN (SELECT machine_id, least(12, greatest(3, count(*) // 20)) AS w FROM readings GROUP BY 1) USING (machine_id)"""))
def smooth_lab(spark, d):
    out = clean.smooth(v.readings(spark, d), ["vibration"], suffix="_smoothed", rule=(12, 3, 20))
    return out.select("event_id", F.round("vibration_smoothed", 6).alias("vibration_smoothed"))


@query("rul_features", sql("readings", "SELECT event_id, " + ", ".join(
    f"round(avg({c}) OVER ({_SERIES} ROWS 23 PRECEDING), 6) AS {c}_roll_mean, "
    f"round(coalesce(stddev_samp({c}) OVER ({_SERIES} ROWS 23 PRECEDING), 0), 6) AS {c}_roll_std, "
    f"round(coalesce({c} - lag({c}) OVER ({_SERIES}), 0), 6) AS {c}_trend" for c in CORE) + " FROM readings"))
def features(spark, d):
    names = [f"{c}_{s}" for c in CORE for s in ("roll_mean", "roll_std", "trend")]
    return rul_features(v.readings(spark, d)).select("event_id", *[F.round(n, 6).alias(n) for n in names])


@query("rolling_trend", sql("readings", f"""
  SELECT event_id, machine_id, round(avg(vibration) OVER ({_SERIES} ROWS 23 PRECEDING), 6) AS rolling FROM readings"""))
def trend_chart(spark, d):
    return rolling_trend(v.readings(spark, d), "vibration").select("event_id", "machine_id", F.round("rolling", 6).alias("rolling"))


@query("rolling_sliced", sql("readings", f"""
  SELECT event_id, round(avg(vibration) OVER ({_SERIES} ROWS 11 PRECEDING), 6) AS rolling, round(rpm - lag(rpm) OVER ({_SERIES}), 6) AS change FROM readings"""))
def rolling_sliced(spark, d):
    """Windows by time slices, as for assets too large for one task: here every asset above 60 rows is cut."""
    df = v.readings(spark, d)
    out = add_windowed(df, {"rolling": rolling_mean("vibration", 12), "change": step("rpm")}, 11, profile=profile_series(df, target_rows=60))
    return _rounded(out, "rolling", "change").select("event_id", "rolling", "change")


@query("rolling_whole_table", sql("gaps", """
  SELECT event_id, round(avg(vibration) OVER (w ROWS 23 PRECEDING), 6) AS vibration_roll_mean,
         round(coalesce(stddev_samp(vibration) OVER (w ROWS 23 PRECEDING), 0), 6) AS vibration_roll_std,
         round(coalesce(rpm - lag(rpm) OVER w, 0), 6) AS rpm_trend FROM gaps WINDOW w AS (ORDER BY "timestamp", event_id)"""))
def rolling_whole_table(spark, d):
    """Window features of a table without an asset column, in slices of 512 rows."""
    out = add_windowed_whole(v.with_gaps(v.readings(spark, d)).drop("machine_id"), {
        "vibration_roll_mean": rolling_mean("vibration", 24), "vibration_roll_std": rolling_std("vibration", 24),
        "rpm_trend": lambda w: F.coalesce(step("rpm")(w), F.lit(0.0)),
    }, 23, ["timestamp", "event_id"], rows_per_slice=512)
    return _rounded(out, "vibration_roll_mean", "vibration_roll_std", "rpm_trend").select("event_id", "vibration_roll_mean", "vibration_roll_std", "rpm_trend")


@query("ffill_whole_table", sql("gaps", """
  SELECT event_id, last_value(vibration IGNORE NULLS) OVER w AS vibration, count(vibration) OVER w AS known
  FROM gaps WINDOW w AS (ORDER BY "timestamp", event_id ROWS UNBOUNDED PRECEDING)"""))
def ffill_whole_table(spark, d):
    """Last known value and a running count over all rows, carried from slice to slice of 512 rows."""
    df = v.with_gaps(v.readings(spark, d)).drop("machine_id").withColumn("one", F.col("vibration").isNotNull().cast("long"))
    counted = running_whole(df, {"known": "one"}, ["timestamp", "event_id"], rows_per_slice=512)
    return forward_fill_whole(counted, ["vibration"], ["timestamp", "event_id"], rows_per_slice=512).select("event_id", "vibration", "known")


@query("jumps", sql("readings", f"""
  SELECT machine_id, count(*) FILTER (abs(dt) > 50) AS big_jumps, round(max(abs(dt)), 6) AS widest FROM (
    SELECT machine_id, temperature - lag(temperature) OVER ({_SERIES}) AS dt FROM readings) GROUP BY 1"""))
def jumps(spark, d):
    moved = add_windowed(v.readings(spark, d), {"dt": step("temperature")}, 1)
    return moved.groupBy("machine_id").agg(
        F.count_if(F.abs("dt") > 50).alias("big_jumps"), F.round(F.max(F.abs("dt")), 6).alias("widest")
    )


@query("latest", sql("readings", f"""
  SELECT machine_id, event_id, temperature, event_type FROM readings
  QUALIFY row_number() OVER (PARTITION BY machine_id ORDER BY "timestamp" DESC, event_id DESC) = 1"""))
def latest(spark, d):
    return latest_per_asset(v.readings(spark, d), ["event_id", "temperature", "event_type"])


@query("filter_assets", sql("readings", """
  SELECT event_id, machine_id FROM readings WHERE machine_id IN (
    SELECT machine_id FROM (SELECT concat('M-', lpad(cast(c_custkey AS VARCHAR), 4, '0')) AS machine_id, c_mktsegment FROM customer)
    WHERE c_mktsegment = 'BUILDING')"""))
def filter_assets(spark, d):
    chosen = v.costs(spark, d).filter("segment = 'BUILDING'")
    return joins.filter_assets(v.readings(spark, d), chosen).select("event_id", "machine_id")
