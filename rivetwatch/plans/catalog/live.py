"""Live payloads and live status, on a table of messages."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ...operators import rul
from ...streaming import life, payload, status
from .. import sensor_view as v
from .registry import query, sql

AS_OF = datetime(2024, 1, 31)


def messages(spark, d):
    """Readings as the JSON a gateway would publish: nested, aliased, partly in bar, partly broken."""
    k = F.col("event_id") % 10
    body = F.struct(
        F.when(k != 3, F.col("machine_id")).alias("uav_id"),
        F.when(k != 4, F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")).alias("time"),
        F.col("temperature").cast("string").alias("temp_c"),
        F.struct(F.col("rpm").alias("rpm"), (F.col("temperature") + 60).alias("exhaust_temp")).alias("Engine"),
        F.when(k == 5, 4.25).alias("oil_pressure_bar"),
        F.when(k != 5, F.when(k == 6, 3.5).otherwise(F.col("oil_pressure"))).alias("oil_pressure"),
        F.when(k == 7, "BAR").alias("oil_pressure_unit"),
    )
    text = F.when(k == 9, "{broken").otherwise(F.to_json(body))
    return v.readings(spark, d, spread=True).select(
        "event_id", F.concat(F.lit("plant/line/"), F.col("machine_id")).alias("topic"), text.alias("value"),
        F.lit(AS_OF).cast("timestamp").alias("arrived"),
    )


@query("canonical_payload", sql("readings", """
  SELECT event_id, machine_id, strftime(CASE WHEN event_id % 10 = 4 THEN TIMESTAMP '2024-01-31' ELSE date_trunc('second', "timestamp") END, '%Y-%m-%d %H:%M:%S') AS read_at,
         event_id % 10 = 4 AS ts_imputed, temperature, rpm, temperature + 60 AS egt, oil AS oil_pressure, oil AS pressure
  FROM (SELECT *, round(CASE WHEN event_id % 10 = 5 THEN 4.25::DOUBLE * 14.5037738::DOUBLE
                             WHEN event_id % 10 = 6 AND event_id % 10 <> 3 THEN CASE WHEN event_id % 10 <> 3 THEN 3.5::DOUBLE * 14.5037738::DOUBLE END
                             WHEN event_id % 10 = 7 THEN oil_pressure * 14.5037738::DOUBLE ELSE oil_pressure END, 3) AS oil FROM readings)
  WHERE event_id % 10 <> 9"""))
def canonical_payload(spark, d):
    rows = payload.canonical_rows(messages(spark, d), topic="topic", arrived="arrived")
    return rows.select(
        "event_id", "machine_id", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("read_at"), "ts_imputed",
        "temperature", "rpm", "egt", "oil_pressure", "pressure",
    )


@query("undecodable", sql("readings", "SELECT event_id, '{broken' AS value FROM readings WHERE event_id % 10 = 9"))
def undecodable(spark, d):
    return payload.undecodable(messages(spark, d)).select("event_id", "value")


@query("publisher_json", sql("gaps", """
  SELECT machine_id AS key, json_extract_string(value, '$.uav_id') AS uav_id, CAST(json_extract(value, '$.temperature') AS DOUBLE) AS temperature
  FROM (SELECT machine_id, to_json({'uav_id': machine_id, 'temperature': temperature}) AS value FROM gaps)"""))
def publisher_json(spark, d):
    out = payload.publisher_json(v.with_gaps(v.readings(spark, d)))
    return out.select(
        "key", F.get_json_object("value", "$.uav_id").alias("uav_id"),
        F.get_json_object("value", "$.temperature").cast("double").alias("temperature"),
    )


_ADVICE = v.advisory_sql("risk_level", "physics_fault", "''",
    "CASE physics_fault WHEN 'Low oil' THEN 'oil_system' WHEN 'Overheating' THEN 'heads_exhaust' WHEN 'High vibration' THEN 'rotating_crank' ELSE '' END", "''")


@query("live_status", sql("scored", f"""
  SELECT *, {v.GO_SQL.replace('action', 'advisory')} AS go_nogo,
         CAST(least(greatest(round_even(health_index, 0), 0), 100) AS INTEGER) AS mission_success_pct,
         round_even(predicted_rul_days * 24.0::DOUBLE * 0.35::DOUBLE, 1) AS predicted_rul_hours
  FROM (
    SELECT machine_id, risk_level, anomaly_rate_pct, {_ADVICE} AS advisory,
           CAST(greatest(1, round_even(CASE WHEN alert THEN base * 0.42::DOUBLE ELSE base END, 0)) AS INTEGER) AS predicted_rul_days,
           round_even(CASE WHEN alert THEN greatest(2, h - 22) ELSE h END, 1) AS health_index, physics_fault, n_rows, last_temperature, age AS last_seen_age_s, age > 30 AS stale
    FROM (
      SELECT *, CASE risk_level WHEN 'High' THEN 38.0::DOUBLE WHEN 'Medium' THEN 72.0::DOUBLE ELSE 92.0::DOUBLE END AS h FROM (
        SELECT *, 28.0::DOUBLE * (1 - least(anomaly_rate_pct, 85) / 100) AS base,
               CASE WHEN alert AND anomaly_rate_pct >= 12 THEN 'High' WHEN alert AND anomaly_rate_pct < 5 THEN 'Medium'
                    WHEN anomaly_rate_pct >= 15 THEN 'High' WHEN anomaly_rate_pct >= 5 THEN 'Medium' ELSE 'Low' END AS risk_level
        FROM (SELECT machine_id, {', '.join(f'arg_max({c}, ("timestamp", event_id)) AS {c}' for c in ('physics_fault',))},
                     arg_max(physics_alert, ("timestamp", event_id)) AS alert, arg_max(temperature, ("timestamp", event_id)) AS last_temperature,
                     CASE WHEN count(*) >= 12 THEN round_even(100.0::DOUBLE * count(*) FILTER (is_anomaly) / count(*), 2) ELSE 0 END AS anomaly_rate_pct,
                     any_value(n) AS n_rows, round_even((epoch_us(TIMESTAMP '2024-01-31') - max(epoch_us("timestamp"))) / 1e6, 1) AS age
              FROM (SELECT *, row_number() OVER (PARTITION BY machine_id ORDER BY "timestamp" DESC, event_id DESC) AS rn,
                           count(*) OVER (PARTITION BY machine_id) AS n FROM lines) WHERE rn <= 240 GROUP BY machine_id))))""",
    lines=v.redline_sql("scored", v.DEFAULT_RULES)))
def live_status(spark, d):
    out = status.live_status(v.scored(v.readings(spark, d)), AS_OF)
    return out.select(
        "machine_id", "risk_level", "anomaly_rate_pct", "advisory", "predicted_rul_days", "health_index", "physics_fault", "n_rows",
        "last_temperature", "last_seen_age_s", "stale", "go_nogo", "mission_success_pct", "predicted_rul_hours",
    )


@query("keep_last_rows", sql("readings", """
  SELECT event_id FROM readings QUALIFY row_number() OVER (PARTITION BY machine_id ORDER BY "timestamp" DESC, event_id DESC) <= 20"""))
def keep_last_rows(spark, d):
    from ...operators.series import last_rows

    return last_rows(v.readings(spark, d), 20).select("event_id")


_LIFE = ("temperature", "vibration", "rpm")


@query("live_rul_features", sql("gaps", "SELECT machine_id, max(\"timestamp\") AS last_ts, " + ", ".join(f"""
  coalesce(max({c}) FILTER (rn = 1), 0) AS {c}, round(coalesce(avg({c}), 0), 6) AS {c}_roll_mean, round(coalesce(stddev_samp({c}), 0), 6) AS {c}_roll_std,
  round(coalesce(max({c}) FILTER (rn = 1) - max({c}) FILTER (rn = 2), 0), 6) AS {c}_trend""" for c in _LIFE) + """
  FROM (SELECT *, row_number() OVER (PARTITION BY machine_id ORDER BY "timestamp" DESC, event_id DESC) AS rn FROM gaps) WHERE rn <= 24 GROUP BY 1"""))
def live_rul_features(spark, d):
    """What the live model looks at: each asset's newest row and the windows that end there."""
    out = life.newest_features(v.with_gaps(v.readings(spark, d)), list(_LIFE))
    return out.withColumns({f"{c}{k}": F.round(f"{c}{k}", 6) for c in _LIFE for k in ("_roll_mean", "_roll_std", "_trend")})


@query("live_rul")
def live_rul(spark, d):
    """Live status of every asset with the remaining life of a fitted forest in place of the proxy."""
    df = v.readings(spark, d)
    sensors = life.sensors_of(df)
    featured = rul.rul_features(v.with_life(df).select("machine_id", "timestamp", "event_id", rul.LABEL, *sensors))
    model = rul.fit_rul(featured, trees=40, depth=8)
    days = life.live_life(df, model)
    return status.live_status(v.scored(df), AS_OF, predictions=days).select("machine_id", "risk_level", "predicted_rul_days", "predicted_rul_hours", "health_index", "go_nogo")
