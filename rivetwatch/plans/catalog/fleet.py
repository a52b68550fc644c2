"""Red-lines, health, KPIs, advice, ranking and the brief."""

from __future__ import annotations

from datetime import datetime
from functools import cached_property

from pyspark.sql import functions as F

from ...operators import advisory, fleet, insights, physics, rul
from ...operators.driver import sensor_drivers
from ...operators.iforest import anomaly_rates, anomaly_summary
from .. import questions
from ..pipeline import advice_bundle
from .. import sensor_view as v
from .registry import query, sql

AVIATION, AUTO, WELL = "aviation_uav_piston", "automotive_powertrain", "oil_srp"


class _Fleet:
    """The per-asset tables of one run.

    Each has one row per asset and is read by several branches, so it is
    persisted the first time it is asked for.
    """

    def __init__(self, spark, d):
        self.df = v.readings(spark, d)

    @cached_property
    def preds(self):
        return rul.proxy_predictions(self.df).persist()

    @cached_property
    def physics(self):
        return physics.summarize_physics(self.df).persist()

    @cached_property
    def health(self):
        return fleet.asset_health(self.df, self.preds).persist()

    @cached_property
    def drivers(self):
        return sensor_drivers(self.df, self.preds).persist()

    @cached_property
    def items(self):
        return advisory.advisory_items(self.preds, self.physics, self.health, self.drivers, self.df).persist()

    @cached_property
    def scored(self):
        return v.scored(self.df)

    @cached_property
    def ranked(self):
        return insights.rank_assets(self.scored, self.preds).persist()


def _preds(spark, d):
    return rul.proxy_predictions(v.readings(spark, d))


def _physics(spark, d):
    return physics.summarize_physics(v.readings(spark, d))


def _ranked(spark, d):
    return _Fleet(spark, d).ranked


# ---------------------------------------------------------------- red-lines
@query("physics_rows", sql("redlines", "SELECT event_id, physics_alert, physics_fault, physics_rule, physics_label FROM redlines"))
def physics_rows(spark, d):
    return physics.apply_physics_rules(v.readings(spark, d)).select("event_id", *physics.PHYSICS_COLUMNS)


@query("physics_rows_aviation", sql("engine", "SELECT event_id, physics_fault, physics_rule, physics_label FROM flown",
                                    flown=v.redline_sql("engine", v.AVIATION_RULES)))
def physics_rows_aviation(spark, d):
    out = physics.apply_physics_rules(v.engine(v.readings(spark, d)), AVIATION)
    return out.select("event_id", "physics_fault", "physics_rule", "physics_label")


@query("physics_summary", sql("physics", "SELECT * FROM physics"))
def physics_summary(spark, d):
    return _physics(spark, d)


_ATA = """CASE WHEN physics_rule LIKE 'Temperature high%' THEN '75-00 Air / cooling' WHEN physics_rule LIKE 'Oil%' THEN '79-00 Oil'
               WHEN physics_rule LIKE 'Vib%' THEN '72-00 Engine' ELSE '—' END"""


@query("physics_table", sql("physics", f"""
  SELECT machine_id AS asset, coalesce(nullif(physics_rule, ''), '—') AS rule_fired, physics_label AS human_label, {_ATA} AS ata_100 FROM physics"""))
def physics_table(spark, d):
    return physics.physics_table(_physics(spark, d))


# ---------------------------------------------------------------- remaining life
@query("proxy_rul", sql("readings", """
  SELECT event_id, round(least(greatest((1 - wear / (max(wear) OVER () + 1e-6)) * 30 + 1, 1), 30), 6) AS proxy_rul
  FROM (SELECT event_id, temperature / (mt + 1e-6) + vibration / (mv + 1e-6) + pressure / (mp + 1e-6) + rpm / (mr + 1e-6) AS wear
        FROM readings, (SELECT max(temperature) AS mt, max(vibration) AS mv, max(pressure) AS mp, max(rpm) AS mr FROM readings))"""))
def proxy_rul(spark, d):
    return rul.proxy_rul(v.readings(spark, d)).select("event_id", F.round("proxy_rul", 6).alias("proxy_rul"))


@query("rul_proxy_predictions", sql("preds", """
  SELECT *, machine_id || ': ' || risk_level || ' risk, about ' || CAST(predicted_rul_days AS VARCHAR)
    || ' days by wear. Estimated from wear; no date of failure is known.' AS message FROM preds"""))
def proxy_predictions(spark, d):
    return _preds(spark, d)


@query("driver", sql("drivers", "SELECT machine_id, risk, sensor, round(value, 6) AS value, round(z, 6) AS z, region, region_label, line FROM drivers"))
def driver(spark, d):
    return _Fleet(spark, d).drivers.withColumns({"value": F.round("value", 6), "z": F.round("z", 6)})


# ---------------------------------------------------------------- anomaly statistics
@query("anomaly_summary", sql("scored", """
  SELECT count(*) AS total_records, count(*) FILTER (is_anomaly) AS anomaly_count,
         round_even(100.0::DOUBLE * count(*) FILTER (is_anomaly) / count(*), 2) AS anomaly_rate_pct,
         round_even(avg(anomaly_score), 4) AS score_mean, round_even(max(anomaly_score), 4) AS score_max FROM scored"""))
def summary(spark, d):
    return anomaly_summary(v.scored(v.readings(spark, d)))


@query("anomaly_rates", sql("scored", """
  SELECT machine_id, round_even(avg(CASE WHEN is_anomaly THEN 1.0::DOUBLE ELSE 0.0 END) * 100, 2) AS anomaly_rate_pct FROM scored GROUP BY 1"""))
def rates(spark, d):
    return anomaly_rates(v.scored(v.readings(spark, d)))


# ---------------------------------------------------------------- health and KPIs
@query("health_index", sql("health", "SELECT * FROM health"))
def health_index(spark, d):
    return _Fleet(spark, d).health


@query("health_aviation", sql("engine preds", "SELECT machine_id, health_index, mission_success_pct FROM h",
                              h=v.health_sql("engine", v.AVIATION_SENSORS)))
def health_aviation(spark, d):
    out = fleet.asset_health(v.engine(v.readings(spark, d)), _preds(spark, d), AVIATION)
    return out.select("machine_id", "health_index", "mission_success_pct")


@query("worst_asset", sql("health", "SELECT machine_id, health_index FROM health ORDER BY health_index, machine_id LIMIT 1"))
def worst(spark, d):
    return fleet.worst_asset(_Fleet(spark, d).health).select("machine_id", "health_index")


_RELIABLE = """SELECT round_even(100 * avg(CASE WHEN predicted_rul_days > 0
    THEN 0.5 * base + 0.5 * (0.25 + 0.75 * least(1.0::DOUBLE, predicted_rul_days / 1.0::DOUBLE)) ELSE base END), 1) AS mission_reliability_pct
  FROM (SELECT *, CASE risk_level WHEN 'High' THEN 0.38::DOUBLE WHEN 'Medium' THEN 0.82::DOUBLE WHEN 'Low' THEN 0.97::DOUBLE ELSE 0.70::DOUBLE END AS base FROM preds)"""


@query("mission_reliability", sql("preds", _RELIABLE))
def mission_reliability(spark, d):
    return fleet.mission_reliability(_preds(spark, d))


_SEV = "CASE WHEN {0} < 55 THEN 'high' WHEN {0} < 75 THEN 'medium' ELSE 'low' END"


def _kpi_sql(rows):
    return " UNION ALL ".join(
        f"SELECT '{kid}' AS id, {label} AS label, CAST({value} AS DOUBLE) AS value, '{unit}' AS unit, {severity} AS severity FROM one"
        for kid, label, value, unit, severity in rows
    )


_ONE = "SELECT avg(health_index) AS fleet, count(*) FILTER (risk_level = 'High') AS n_high FROM {0}"
_WORST = "SELECT machine_id, predicted_rul_days, health_index AS worst_health FROM {0} ORDER BY health_index, predicted_rul_days NULLS LAST, machine_id LIMIT 1"
_LAST = 'arg_max({0}, ("timestamp", event_id))'


def _kpi_query(pack_id, source):
    def run(spark, d):
        df = v.readings(spark, d)
        df = v.engine(df) if source == "engine" else df
        return fleet.pack_kpis(df, _preds(spark, d), pack_id).select("id", "label", "value", "unit", "severity")

    return run


query("kpis_plant", sql("health", _kpi_sql([
    ("asset_health_index", "'Fleet health index'", "round_even(fleet, 1)", "/100", _SEV.format("fleet")),
    ("high_risk_assets", "'High-risk assets'", "n_high", "assets", "CASE WHEN n_high > 0 THEN 'high' ELSE 'low' END"),
    ("predicted_rul_days", "'Worst-asset RUL (' || machine_id || ')'", "predicted_rul_days", "days", _SEV.format("worst_health")),
]), one=f"SELECT * FROM ({_ONE.format('health')}), ({_WORST.format('health')})"))(_kpi_query("plant_rotating", "readings"))

query("kpis_aviation", sql("engine preds", _kpi_sql([
    ("engine_health_index", "'Piston-engine health'", "round_even(fleet, 1)", "/100", _SEV.format("fleet")),
    ("mission_reliability_pct", "'Mission reliability'", "mission_reliability_pct", "%",
     "CASE WHEN mission_reliability_pct < 60 THEN 'high' WHEN mission_reliability_pct < 80 THEN 'medium' ELSE 'low' END"),
    ("remaining_mission_hours", "'Remaining mission hours (worst UAV)'", "hours", "h",
     "CASE WHEN hours < 8 THEN 'high' WHEN hours < 24 THEN 'medium' ELSE 'low' END"),
    ("egt_margin", "'EGT margin (latest vs typical)'", "margin", "°C", "CASE WHEN margin < 5 THEN 'high' ELSE 'low' END"),
]), h=v.health_sql("engine", v.AVIATION_SENSORS), one=f"""
  SELECT *, round_even(predicted_rul_days * 24.0::DOUBLE * 0.35::DOUBLE, 1) AS hours
  FROM ({_ONE.format('h')}), ({_WORST.format('h')}), ({_RELIABLE}),
       (SELECT round_even(round_even(quantile_cont(egt, 0.5), 1) + 40 - round_even({_LAST.format('egt')}, 1), 1) AS margin FROM engine)"""))(
    _kpi_query(AVIATION, "engine"))

query("kpis_auto", sql("engine preds", _kpi_sql([
    ("powertrain_health_index", "'Powertrain health'", "round_even(fleet, 1)", "/100", _SEV.format("fleet")),
    ("oil_pressure_status", "'Oil pressure'", "round_even(oil, 1)", "psi", "CASE WHEN oil < 20 THEN 'high' ELSE 'low' END"),
    ("thermal_headroom", "'Coolant headroom to 105 °C'", "room", "°C", "CASE WHEN room < 8 THEN 'high' ELSE 'low' END"),
]), h=v.health_sql("engine", v.AUTO_SENSORS), one=f"""
  SELECT *, round_even(greatest(0, 105.0 - cool), 1) AS room
  FROM ({_ONE.format('h')}), (SELECT {_LAST.format('oil_pressure')} AS oil, {_LAST.format('coolant_temp')} AS cool FROM engine)"""))(
    _kpi_query(AUTO, "engine"))

query("kpis_oil", sql("engine preds", _kpi_sql([
    ("well_health_index", "'Well / SRP health'", "round_even(fleet, 1)", "/100", _SEV.format("fleet")),
    ("pump_fillage_pct", "'Pump fillage'", "round_even(fill, 1)", "%", "CASE WHEN fill < 70 THEN 'high' ELSE 'low' END"),
    ("production_rate", "'Latest production'", "round_even(prod, 2)", "bbl", "CASE WHEN prod < 20 THEN 'medium' ELSE 'low' END"),
]), h=v.health_sql("engine", v.WELL_SENSORS), one=f"""
  SELECT * FROM ({_ONE.format('h')}), (SELECT {_LAST.format('pump_fillage')} AS fill, {_LAST.format('production_bbl')} AS prod FROM engine)"""))(
    _kpi_query(WELL, "engine"))


@query("kpi_narrative", sql("health", """
  SELECT 'plant_rotating' AS pack_id, 'Plant / rotating machines | worst health: ' || machine_id || ' with ' || CAST(worst_health AS VARCHAR)
    || ' of 100, ' || worst_risk || ' risk | Fleet health index ' || CAST(round_even(fleet, 1) AS VARCHAR) || ' /100, High-risk assets '
    || CAST(n_high AS VARCHAR) || ' assets, Worst-asset RUL (' || machine_id || ') ' || CAST(predicted_rul_days AS VARCHAR) || ' days' AS narrative
  FROM one""", one=f"""SELECT *, (SELECT risk_level FROM health h WHERE h.machine_id = w.machine_id) AS worst_risk
  FROM ({_ONE.format('health')}), ({_WORST.format('health')}) w"""))
def narrative(spark, d):
    run = _Fleet(spark, d)
    health = run.health
    kpis = fleet.pack_kpis(run.df, run.preds, health=health).persist()
    return fleet.kpi_narrative(kpis, health).drop("worst")


@query("kpi_insights", sql("health", """
  SELECT 'Key figures: Plant / rotating machines' AS title, 'info' AS severity FROM one
  UNION ALL SELECT 'Fleet health index', CASE WHEN fleet < 55 THEN 'high' WHEN fleet < 75 THEN 'medium' ELSE 'info' END FROM one
  UNION ALL SELECT 'High-risk assets', CASE WHEN n_high > 0 THEN 'high' ELSE 'info' END FROM one
  UNION ALL SELECT 'Worst-asset RUL (' || machine_id || ')', CASE WHEN worst_health < 55 THEN 'high' WHEN worst_health < 75 THEN 'medium' ELSE 'info' END FROM one
  UNION ALL SELECT 'Start with ' || machine_id, 'high' FROM one WHERE (SELECT risk_level FROM health h WHERE h.machine_id = one.machine_id) = 'High'""",
  one=f"SELECT * FROM ({_ONE.format('health')}), ({_WORST.format('health')})"))
def kpi_insights(spark, d):
    run = _Fleet(spark, d)
    health = run.health
    kpis = fleet.pack_kpis(run.df, run.preds, health=health).persist()
    return fleet.kpi_insights(kpis, fleet.kpi_narrative(kpis, health)).select("title", "severity")


@query("kpi_bars", sql("health", """
  SELECT 'Fleet health index' AS label, round_even(avg(health_index), 1) AS value FROM health
  UNION ALL SELECT 'High-risk assets', CAST(count(*) FILTER (risk_level = 'High') AS DOUBLE) FROM health
  UNION ALL SELECT 'Worst-asset RUL (' || machine_id || ')', CAST(predicted_rul_days AS DOUBLE) FROM one""", one=_WORST.format("health")))
def kpi_bars(spark, d):
    from ...operators.charts import kpi_bars as bars

    run = _Fleet(spark, d)
    return bars(fleet.pack_kpis(run.df, run.preds, health=run.health)).select("label", "value")


@query("health_by_asset", sql("health", "SELECT machine_id, health_index, risk_level FROM health"))
def health_by_asset(spark, d):
    from ...operators.charts import health_by_asset as chart

    return chart(_Fleet(spark, d).health)


# ---------------------------------------------------------------- advice
@query("advisory", sql("items", "SELECT * FROM items"))
def advisory_rows(spark, d):
    return _Fleet(spark, d).items


@query("advice_bundle", sql("items", "SELECT * FROM items"))
def advice(spark, d):
    run = _Fleet(spark, d)
    return advice_bundle(run.df, run.preds, run.health).items


@query("advisory_text", sql("items", """
  SELECT string_agg(machine_id || ': ' || action, ' · ' ORDER BY machine_id) AS advisory FROM items"""))
def advisory_text(spark, d):
    return advisory.advisory_text(_Fleet(spark, d).items)


@query("asset_table", sql("assets", "SELECT * FROM assets"))
def asset_table(spark, d):
    run = _Fleet(spark, d)
    return advisory.asset_table(run.df, run.preds, run.health, run.items, run.physics)


@query("fleet_strip", sql("items", f"""
  SELECT machine_id AS tail, mission_success_pct AS mission_pct, action AS advisory, {v.GO_SQL} AS go_nogo, risk_level AS risk, health_index AS health FROM items"""))
def fleet_strip(spark, d):
    run = _Fleet(spark, d)
    return advisory.fleet_strip(run.items, run.health)


@query("health_events", sql("scored items preds physics drivers", f"""
  SELECT machine_id AS asset, 'pdm.health_event.v1' AS schema, strftime(s.ts, '%Y-%m-%dT%H:%M:%SZ') AS time, 'plant_rotating' AS pack_id,
         s.temperature, s.vibration, s.oil_pressure, f.physics_alert AS alert, f.physics_fault AS fault, f.physics_rule AS rule, f.physics_label AS label,
         s.score AS anomaly_score, s.flag AS is_anomaly, p.predicted_rul_days, p.is_proxy, p.risk_level, i.action AS advisory,
         CASE WHEN f.region <> '' THEN f.region ELSE d.region END AS twin_region, i.health_index, i.mission_success_pct,
         CASE WHEN code <> '' THEN 'WO-' || machine_id || '-' || code ELSE '' END AS work_order_id
  FROM (SELECT *, {v.CODE_SQL} AS code FROM items) i JOIN preds p USING (machine_id) JOIN physics f USING (machine_id) JOIN drivers d USING (machine_id)
  JOIN (SELECT machine_id, max("timestamp") AS ts, round_even({_LAST.format('temperature')}, 4) AS temperature,
               round_even({_LAST.format('vibration')}, 4) AS vibration, round_even({_LAST.format('oil_pressure')}, 4) AS oil_pressure,
               round_even({_LAST.format('anomaly_score')}, 4) AS score, {_LAST.format('is_anomaly')} AS flag
        FROM scored GROUP BY 1) s USING (machine_id)"""))
def health_events(spark, d):
    run = _Fleet(spark, d)
    events = advisory.health_events(
        run.scored, run.preds, run.physics, run.items, run.health, run.drivers, as_of=datetime(2024, 1, 31)
    )
    return events.select(
        "asset", "schema", "time", "pack_id", *[F.col("sensors")[c].alias(c) for c in ("temperature", "vibration", "oil_pressure")],
        "physics.alert", "physics.fault", "physics.rule", "physics.label", "iforest.anomaly_score", "iforest.is_anomaly",
        "rul.predicted_rul_days", "rul.is_proxy", "risk_level", "advisory", "twin_region", "health_index",
        "mission_success_pct", "work_order_id",
    )


# ---------------------------------------------------------------- ranking and brief
@query("rank", sql("ranked", """
  SELECT machine_id, rank, n_rows, mean_anomaly_score, max_anomaly_score, anomaly_count, anomaly_rate_pct, predicted_rul_days, risk_level, moved FROM ranked"""))
def rank(spark, d):
    return _ranked(spark, d).drop("why", "is_proxy")


@query("why", sql("ranked", "SELECT machine_id, array_to_string(why, '; ') AS why FROM ranked"))
def why(spark, d):
    return _ranked(spark, d).select("machine_id", F.array_join("why", "; ").alias("why"))


INSPECT_SQL = """SELECT rank, 'Due for inspection: ' || machine_id AS title, risk_level AS severity, machine_id,
  machine_id || ' is due within the week: ' || array_to_string(why, '; ')
  || '. Estimated from wear; no date of failure is known.' AS message FROM ranked
  WHERE risk_level = 'High' OR (risk_level = 'Medium' AND (predicted_rul_days <= 14 OR anomaly_rate_pct >= 8))
     OR (mean_anomaly_score > 0 AND anomaly_count > 0)
     OR (predicted_rul_days <= 21 AND moved)"""


@query("inspect", sql("ranked", INSPECT_SQL + " ORDER BY rank LIMIT 8"))
def inspect(spark, d):
    return insights.inspect_this_week(_ranked(spark, d))


@query("inspect_all", sql("ranked", INSPECT_SQL))
def inspect_all(spark, d):
    return insights.inspect_this_week(_ranked(spark, d), most=None)


@query("slow", sql("slow", """
  SELECT machine_id, title, severity, "column", round(mean, 6) AS mean, fleet_median, round(gap_pct, 6) AS gap_pct, message FROM slow"""))
def slow(spark, d):
    out = insights.slow_running(v.throughput(v.readings(spark, d)))
    return out.withColumns({"mean": F.round("mean", 6), "gap_pct": F.round("gap_pct", 6)})


@query("slow_speed", sql("readings", """
  SELECT machine_id, round(mean, 6) AS mean, round((mean - mid) / mid * 100, 6) AS gap_pct
  FROM (SELECT machine_id, avg(speed) AS mean, quantile_cont(speed, 0.5) AS own, count(*) AS n FROM s GROUP BY 1), (SELECT quantile_cont(speed, 0.5) AS mid FROM s)
  WHERE (mean - mid) / mid * 100 <= -8 OR (mean - CASE WHEN n >= 3 THEN own ELSE mid END) / CASE WHEN n >= 3 THEN own ELSE mid END * 100 <= -8""",
  s="SELECT machine_id, temperature AS speed FROM readings"))
def slow_speed(spark, d):
    df = v.readings(spark, d).select("machine_id", "timestamp", "event_id", F.col("temperature").alias("speed"))
    return insights.slow_running(df).select("machine_id", F.round("mean", 6).alias("mean"), F.round("gap_pct", 6).alias("gap_pct"))


@query("dollars", sql("ranked slow", """
  SELECT 1 AS section, 'Cost of a stop: ' || machine_id AS title, risk_level AS severity, machine_id, dollars,
         machine_id || ', ' || risk_level || ' risk: a stop of ' || printf('%.1f', h) || ' h costs $' || format('{:,}', CAST(dollars AS BIGINT))
         || ' at $1,500 an hour. Hours as given, none planned.' AS message
  FROM (SELECT machine_id, risk_level, CASE WHEN risk_level = 'High' THEN 8.0::DOUBLE ELSE 4.0::DOUBLE END AS h, CASE WHEN risk_level = 'High' THEN 12000.0::DOUBLE ELSE 6000.0::DOUBLE END AS dollars
        FROM ranked WHERE risk_level IN ('High', 'Medium'))
  UNION ALL
  SELECT 2, 'Output missed: ' || machine_id, 'Medium', machine_id, round((fleet_median - mean) * 20 * 8, 6), NULL FROM slow"""))
def dollars(spark, d):
    slow_rows = insights.slow_running(v.throughput(v.readings(spark, d)))
    out = insights.dollar_impact(_ranked(spark, d), slow_rows, per_hour=1500, per_unit=20)
    return out.select(
        "section", "title", "severity", "machine_id", F.round("dollars", 6).alias("dollars"),
        F.when(F.col("section") == 1, F.col("message")).alias("message"),
    )


@query("label_honesty", sql("life preds", """
  SELECT has AND proxies = 0 AS labelled, NOT (has AND proxies = 0) AND n > 0 AS used_synthetic
  FROM (SELECT count(failure_within_days) > 0 AS has FROM life), (SELECT count(*) AS n, count(*) FILTER (is_proxy) AS proxies FROM preds)"""))
def label_honesty(spark, d):
    return insights.label_honesty(v.with_life(v.readings(spark, d)), _preds(spark, d))


@query("brief", sql("ranked", f"""
  SELECT 1 AS section, 'About these figures' AS title, 'Info' AS severity FROM (SELECT count(*) FROM ranked)
  UNION ALL SELECT 2, 'First in the ranking', risk_level FROM ranked WHERE rank = 1
  UNION ALL SELECT 3, title, severity FROM ({INSPECT_SQL} ORDER BY rank LIMIT 5)
  UNION ALL SELECT 5, 'Cost of a stop: ' || machine_id, risk_level FROM (
    SELECT machine_id, risk_level FROM ranked WHERE risk_level IN ('High', 'Medium') ORDER BY rank LIMIT 6)"""))
def brief(spark, d):
    run = _Fleet(spark, d)
    out = insights.industrial_brief(run.scored, run.preds, per_hour=1500)
    return out.select("section", "title", "severity")


@query("twin_states", sql("preds", "SELECT machine_id, risk_level, predicted_rul_days FROM preds"))
def twin_states(spark, d):
    return insights.twin_states(_preds(spark, d))


# ---------------------------------------------------------------- standing questions
@query("ask_most_urgent", sql("ranked", """
  SELECT machine_id, risk_level, predicted_rul_days, array_to_string(list_slice(why, 1, 3), '; ') AS why FROM ranked WHERE rank = 1"""))
def ask_most_urgent(spark, d):
    return questions.most_urgent(_ranked(spark, d))


@query("ask_named_asset", sql("ranked", """
  SELECT machine_id, rank, risk_level, predicted_rul_days, array_to_string(why, '; ') AS why FROM ranked WHERE machine_id = 'M-0041'"""))
def ask_named(spark, d):
    return questions.named_asset(_ranked(spark, d), "Why is m-0041 failing?")


@query("ask_slowest", sql("slow", "SELECT machine_id, message FROM slow ORDER BY gap_pct, machine_id LIMIT 1"))
def ask_slowest(spark, d):
    return questions.slowest(insights.slow_running(v.throughput(v.readings(spark, d)))).select("machine_id", "message")


@query("ask_anomalies", sql("scored", """
  SELECT count(*) FILTER (is_anomaly) AS flagged, count(*) AS rows, round(100.0::DOUBLE * count(*) FILTER (is_anomaly) / count(*), 2) AS rate_pct FROM scored"""))
def ask_anomalies(spark, d):
    return questions.anomaly_count(v.scored(v.readings(spark, d)))
