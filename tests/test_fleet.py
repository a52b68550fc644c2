"""Known answers for red-lines, scalars, advice, KPIs and the brief."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rivetwatch.functions import scalars as s
from rivetwatch.operators import advisory, driver, fleet, insights, physics, rul

T0 = datetime(2026, 1, 1)
PRED = "machine_id string, predicted_rul_days int, risk_level string, is_proxy boolean, label_source string"


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())] if values else [(1,)], list(values) or ["x"])
    return df.select(expr.alias("r")).first()["r"]


def preds(spark, rows):
    return spark.createDataFrame([(*r, False, "failure_within_days") for r in rows], PRED)


def frame(spark, columns, rows):
    """Rows get hourly times and a running tie."""
    full = [(i, T0 + timedelta(hours=i), *r) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, ["event_id", "timestamp", *columns])


# ---------------------------------------------------------------- red-lines
def test_aviation_red_lines(spark):
    df = frame(spark, ["machine_id", "egt", "cht", "oil_pressure", "vibration"], [
        ("U", 700.0, 170.0, 60.0, 1.5), ("U", 850.0, 170.0, 60.0, 6.2), ("U", 700.0, 260.0, 60.0, 1.5), ("U", 700.0, 170.0, 30.0, 1.5)])
    rows = physics.apply_physics_rules(df, "aviation_uav_piston").orderBy("event_id").collect()
    assert [r["physics_fault"] for r in rows] == ["None", "Overheating", "Overheating", "Low oil"]
    assert rows[1]["physics_rule"] == "EGT high; Vibration high"
    assert [r["physics_alert"] for r in rows] == [False, True, True, True]


def test_alias_red_lines_and_priority(spark):
    df = frame(spark, ["machine_id", "egt_c", "oil_psi", "vib"], [("U", 900.0, 12.0, 9.0)])
    assert physics.apply_physics_rules(df, "aviation_uav_piston").first()["physics_fault"] == "Low oil"


def test_default_limits_and_null(spark):
    df = frame(spark, ["machine_id", "oil_pressure"], [("E", 30.0)])
    assert physics.apply_physics_rules(df, "automotive_powertrain").first()["physics_fault"] == "None"
    blank = spark.createDataFrame([(1, T0, "E", None)], "event_id int, timestamp timestamp, machine_id string, temperature double")
    assert physics.apply_physics_rules(blank).first()["physics_alert"] is False


def test_alert_iff_rule(spark, sf):
    from rivetwatch.plans import sensor_view as v

    out = physics.apply_physics_rules(v.with_gaps(v.readings(spark, sf)))
    assert out.filter("physics_alert <> (physics_rule <> '')").count() == 0


def test_invalid_ids_are_skipped(spark):
    df = spark.createDataFrame(
        [(1, T0, "UAV-01", 1.0), (2, T0, "nan", 1.0), (3, T0, "", 1.0), (4, T0, None, 1.0)],
        "event_id int, timestamp timestamp, machine_id string, temperature double",
    )
    assert [r["machine_id"] for r in physics.summarize_physics(df).collect()] == ["UAV-01"]


# ---------------------------------------------------------------- scalars
@pytest.mark.parametrize("health,want", [(-5.0, 0), (140.0, 100), (73.2, 73), (None, 0), (float("nan"), 0), (72.5, 72), (73.5, 74)])
def test_mission_success(spark, health, want):
    df = spark.createDataFrame([(health,)], "h double")
    assert df.select(s.mission_success(F.col("h"))).first()[0] == want


def test_mission_hours(spark):
    df = spark.createDataFrame([(10.0,), (None,), (-1.0,)], "d double")
    assert [r[0] for r in df.select(s.mission_hours(F.col("d"), 0.5)).collect()] == [120.0, 0.0, 0.0]


@pytest.mark.parametrize("text,want", [("HIGH!", "High"), ("severe", "High"), (" warn ", "Medium"), ("ok", "Low"), (None, "Unknown"), ("zzz", "Unknown")])
def test_normalize_risk(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(s.normalize_risk(F.col("t"))).first()[0] == want


@pytest.mark.parametrize("risk,fault,sensor,region,phrase,want", [
    ("High", "Low oil", None, None, None, "Inspect oil"),
    ("High", "Overheating", None, None, None, "Check cooling"),
    ("High", "None", "egt", "heads_exhaust", None, "Check cooling"),
    ("High", "None", "vibration", "rotating_crank", None, "Inspect rotating assembly"),
    ("High", "None", None, None, None, "Inspect"),
    ("High", "None", "map", "intake", "intake", "Inspect intake"),
    ("Medium", "None", "oil_temp", "oil_system", "oil system", "Monitor / inspect oil system"),
    ("Medium", "None", None, None, None, "Monitor"),
    ("Low", "None", None, None, None, "OK"),
    ("Low", "High vibration", None, None, None, "Inspect rotating assembly"),
])
def test_advisory_action(spark, risk, fault, sensor, region, phrase, want):
    df = spark.createDataFrame([(risk, fault, sensor, region, phrase)], "r string, f string, s string, g string, p string")
    assert df.select(s.advisory_action(F.col("r"), F.col("f"), F.col("s"), F.col("g"), F.col("p"))).first()[0] == want


def test_work_orders_and_decision(spark):
    df = spark.createDataFrame([("UAV-03", "Inspect oil", "High"), ("UAV-01", "OK", "Low"), ("Machine 1", "Monitor", "Medium")], ["m", "a", "r"])
    out = df.select(s.work_order_id(F.col("m"), F.col("a")).alias("w"), s.go_nogo(F.col("a"), F.col("r")).alias("g")).collect()
    assert [tuple(r) for r in out] == [("WO-UAV-03-OIL", "NO-GO"), ("", "GO"), ("WO-MACHINE-1-MON", "CAUTION")]


def test_ata_money_and_regions(spark):
    df = spark.createDataFrame([("Overheating", "EGT high; Vibration high", 12000.0, "exhaust_temp")], ["f", "r", "d", "n"])
    out = df.select(
        s.ata_label(F.col("f"), F.col("r")).alias("ata"), s.ata_label(F.col("f"), F.lit("")).alias("fault"),
        s.ata_label(F.lit("None"), F.lit("")).alias("none"), s.money(F.col("d")).alias("big"), s.money(F.lit(-3.456)).alias("small"),
        s.sensor_region(F.col("n")).alias("reg"), s.sensor_display(F.col("n")).alias("disp"), s.sensor_display(F.lit("egt")).alias("bare"),
        s.twin_region(F.lit("None"), F.lit(None).cast("string"), F.lit("oil_temp")).alias("twin"),
    ).first()
    assert tuple(out) == ("72-00 Engine", "75-00 Air / cooling", "—", "$12,000", "-$3.46", "heads_exhaust", "exhaust_temp (EGT)", "egt", "oil_system")


def test_last_seen(spark):
    ts = datetime(2026, 1, 1, 16)
    df = spark.createDataFrame([(1, ts, ts + timedelta(seconds=10)), (2, ts, ts + timedelta(seconds=120)), (3, None, ts)],
                               "i int, ts timestamp, now timestamp")
    out = df.select("i", *[c.alias(k) for k, c in s.last_seen(F.col("ts"), F.col("now")).items()]).orderBy("i").collect()
    assert [(r["stale"], r["last_seen_age_s"]) for r in out] == [(False, 10.0), (True, 120.0), (True, None)]
    assert out[0]["last_seen"] == "2026-01-01T16:00:00Z" and out[2]["last_seen"] == ""


# ---------------------------------------------------------------- driver
def test_driver_names_the_odd_sensor(spark):
    rows = [(f"UAV-0{1 + i % 3}", 700.0 + i, 5000.0 + 3 * i) for i in range(11)] + [("UAV-03", 980.0, 5000.0)]
    df = frame(spark, ["machine_id", "exhaust_temp", "rpm"], rows)
    out = {r["machine_id"]: r for r in driver.sensor_drivers(df, preds(spark, [("UAV-03", 3, "High"), ("UAV-01", 30, "Low")])).collect()}
    assert out["UAV-03"]["line"] == "High driven by exhaust_temp (EGT) → heads / exhaust"
    assert out["UAV-01"]["line"] == "" and out["UAV-01"]["sensor"] == ""


def test_driver_flat_column(spark):
    rows = [("A", 90.0, 10.0 + i % 2) for i in range(8)] + [("B", 140.0, 10.0)]
    df = frame(spark, ["machine_id", "oil_temp", "rpm"], rows)
    out = driver.sensor_drivers(df, preds(spark, [("B", 3, "High")])).first()
    assert (out["sensor"], out["region"], out["z"]) == ("oil_temp", "oil_system", 1.0)


# ---------------------------------------------------------------- KPIs
def _sick(spark, columns, good, bad):
    rows = [("G", *good)] * 4 + [("B", *good)] * 3 + [("B", *bad)]
    return frame(spark, ["machine_id", *columns], rows), preds(spark, [("G", 25, "Low"), ("B", 4, "High")])


@pytest.mark.parametrize("pack,columns,good,bad,ids", [
    ("plant_rotating", ["vibration", "temperature"], (2.0, 70.0), (8.0, 99.0), ["asset_health_index", "high_risk_assets", "predicted_rul_days"]),
    ("aviation_uav_piston", ["egt", "oil_pressure"], (700.0, 60.0), (790.0, 41.0), ["engine_health_index", "mission_reliability_pct", "remaining_mission_hours", "egt_margin"]),
    ("automotive_powertrain", ["coolant_temp", "oil_pressure"], (85.0, 40.0), (101.0, 15.0), ["powertrain_health_index", "oil_pressure_status", "thermal_headroom"]),
    ("oil_srp", ["pump_fillage", "production_bbl"], (90.0, 30.0), (60.0, 12.0), ["well_health_index", "pump_fillage_pct", "production_rate"]),
])
def test_kpis_per_pack(spark, pack, columns, good, bad, ids):
    df, p = _sick(spark, columns, good, bad)
    health = fleet.asset_health(df, p, pack)
    assert health.orderBy(*fleet.health_order()).first()["machine_id"] == "B"
    rows = fleet.pack_kpis(df, p, pack).orderBy("position").collect()
    assert [r["id"] for r in rows] == ids
    if pack == "automotive_powertrain":
        assert rows[1]["severity"] == "high" and rows[2]["value"] == 4.0
    cards = fleet.kpi_insights(fleet.pack_kpis(df, p, pack), fleet.kpi_narrative(fleet.pack_kpis(df, p, pack), health, pack), pack)
    assert "Start with B" in {r["title"] for r in cards.collect()}


def test_predicted_only_asset_keeps_its_risk_health(spark):
    df, p = _sick(spark, ["vibration"], (2.0,), (8.0,))
    more = p.unionByName(preds(spark, [("Z", 4, "High")]))
    out = {r["machine_id"]: r["health_index"] for r in fleet.asset_health(df, more).collect()}
    assert out["Z"] == 38.0
    assert fleet.worst_asset(fleet.asset_health(df, more), chosen="G").first()["machine_id"] == "G"


def test_string_order_quirk_is_fixed(spark):
    df = frame(spark, ["machine_id", "temperature"], [("A", 1.0), ("B", 1.0)])
    health = fleet.asset_health(df, preds(spark, [("A", 12, "Low"), ("B", 9, "Low")]))
    same = health.withColumn("health_index", F.lit(50.0))
    assert [r["machine_id"] for r in same.orderBy(*fleet.health_order()).collect()] == ["B", "A"]


# ---------------------------------------------------------------- advisory line, events
def test_advisory_line_and_events(spark):
    df = frame(spark, ["machine_id", "egt", "cht", "oil_pressure", "vibration"], [
        ("UAV-01", 700.0, 170.0, 40.0, 1.5), ("UAV-02", 700.0, 170.0, 60.0, 1.5), ("UAV-03", 850.0, 170.0, 60.0, 1.5)])
    p = preds(spark, [("UAV-01", 4, "High"), ("UAV-02", 30, "Low"), ("UAV-03", 5, "High")])
    pack = "aviation_uav_piston"
    phys, health = physics.summarize_physics(df, pack), fleet.asset_health(df, p, pack)
    items = advisory.advisory_items(p, phys, health)
    assert advisory.advisory_text(items).first()[0] == "UAV-01: Inspect oil · UAV-02: OK · UAV-03: Check cooling"
    events = advisory.health_events(df, p, phys, items, health, pack_id=pack)
    assert advisory.missing_event_keys(events) == []
    first = events.filter("asset = 'UAV-01'").first()
    assert first["work_order_id"] == "WO-UAV-01-OIL" and first["twin_region"] == "oil_system"
    assert first["sensors"]["oil_pressure"] == 40.0 and first["physics"]["fault"] == "Low oil"
    table = advisory.asset_table(df, p, health, items, phys, pack).orderBy(*advisory.decision_order()).collect()
    assert [r["go_nogo"] for r in table] == ["NO-GO", "NO-GO", "GO"]


# ---------------------------------------------------------------- brief
@pytest.fixture(scope="module")
def lines(spark):
    rows = []
    for i in range(4):
        rows += [("LineA", 2.0, 1500.0 + i, 70.0, 100.0 + i), ("LineB", 8.2, 1085.0 + i, 96.0, 60.0 + i), ("LineC", 3.0, 1450.0 + i, 75.0, 95.0 + i)]
    df = frame(spark, ["machine_id", "vibration", "rpm", "temperature", "throughput"], rows)
    df = df.withColumn("anomaly_score", F.when(F.col("machine_id") == "LineB", 0.7).otherwise(0.4)).withColumn("is_anomaly", F.col("machine_id") == "LineB")
    return df, preds(spark, [("LineB", 3, "High"), ("LineC", 12, "Medium"), ("LineA", 25, "Low")])


def test_rank_inspect_slow_money(spark, lines):
    df, p = lines
    ranked = insights.rank_assets(df, p)
    assert [r["machine_id"] for r in ranked.orderBy("rank").collect()] == ["LineB", "LineC", "LineA"]
    assert "LineB" in {r["machine_id"] for r in insights.inspect_this_week(ranked).collect()}
    slow = insights.slow_running(df)
    assert [r["machine_id"] for r in slow.collect()] == ["LineB"]
    money = insights.dollar_impact(ranked, slow, per_hour=1500, hours=8).filter("machine_id = 'LineB'").first()
    assert money["dollars"] == 12000.0 and "$12,000" in money["message"]
    assert insights.dollar_impact(ranked, slow).count() == 0


def test_brief_sections_and_honesty(spark, lines):
    df, p = lines
    brief = insights.industrial_brief(df.withColumn("failure_within_days", F.lit(3.0)), p).collect()
    titles = [r["title"] for r in brief]
    assert {"About these figures", "First in the ranking", "Below pace: LineB", "No money figures"} <= set(titles)
    note = next(r["message"] for r in brief if r["title"] == "About these figures")
    assert note.startswith("Days left were learned from the table")
    proxy = p.withColumn("is_proxy", F.lit(True))
    assert tuple(insights.label_honesty(df, proxy).first()) == (False, True)


def test_rank_is_dense_under_many_equal_assets(spark):
    df = spark.range(400).select(F.col("id").alias("event_id"), F.lit(T0).cast("timestamp").alias("timestamp"),
                                 F.concat(F.lit("A"), F.col("id")).alias("machine_id"), F.rand(1).alias("anomaly_score"),
                                 F.lit(False).alias("is_anomaly"), F.lit(1.0).alias("temperature"))
    empty = spark.createDataFrame([], PRED)
    ranked = insights.rank_assets(df, empty).orderBy("rank").collect()
    assert [r["rank"] for r in ranked] == list(range(1, 401))
    scores = [r["mean_anomaly_score"] for r in ranked]
    assert scores == sorted(scores, reverse=True)


def test_proxy_rul_bounds_and_messages(spark, sf):
    from rivetwatch.plans import sensor_view as v

    df = v.readings(spark, sf)
    low, high = rul.proxy_rul(df).agg(F.min("proxy_rul"), F.max("proxy_rul")).first()
    assert 1.0 <= low <= high <= 30.0
    row = rul.proxy_predictions(df).first()
    assert row["is_proxy"] and "no date of failure" in row["message"]
    with pytest.raises(ValueError):
        rul.proxy_rul(df.select("event_id"))
