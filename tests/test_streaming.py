"""Payload fixtures, and stream results equal to batch results on the same rows."""

from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from rivetwatch.functions.columns import Keys
from rivetwatch.plans import sensor_view as v
from rivetwatch.plans.catalog.live import messages
from rivetwatch.streaming import payload, sources, status

NOW = datetime(2026, 1, 1)


def canonical(spark, body, topic=None, pack=None):
    text = body if isinstance(body, str) else json.dumps(body)
    df = spark.createDataFrame([(text, topic, NOW)], "value string, topic string, arrived timestamp")
    return payload.canonical_rows(df, topic="topic", arrived="arrived", pack_id=pack).first()


def test_bar_oil_pressure(spark):
    row = canonical(spark, {"uav_id": "UAV-77", "cht": 171, "egt": 702, "oil_pressure": 3.5, "oil_pressure_unit": "bar",
                            "rpm": 4875, "vibration": 0.31, "fuel_flow": 3.4})
    assert row["machine_id"] == "UAV-77" and row["temperature"] == 171.0
    assert row["oil_pressure"] == pytest.approx(50.763) and row["pressure"] == row["oil_pressure"]
    assert row["ts_imputed"] and row["timestamp"] == NOW


def test_strings_nesting_and_fallbacks(spark):
    bodies = [
        ({"machine_id": "M-9", "temperature": "70.5", "vibration": 2.1}, None),
        ({"Engine": {"RPM": 900, "exhaust_temp": 700}, "tail": "T1", "time": "2026-01-01 10:00:00"}, None),
        ({"temperature": 10}, None),
        ({"temperature": 10}, "plant/line/M-7"),
        ("5", None),
        ({"machine_id": "M", "oil_pressure": 4.0}, None),
        ({"ecu_index": 7, "cylinder_head_temperature": 180, "intake_manifold_pressure": 30, "throttle_position": 55}, None),
        ("{broken", None),
    ]
    rows = [(i, b if isinstance(b, str) else json.dumps(b), t, NOW) for i, (b, t) in enumerate(bodies)]
    df = spark.createDataFrame(rows, "i int, value string, topic string, arrived timestamp")
    out = {r["i"]: r for r in payload.canonical_rows(df, topic="topic", arrived="arrived").collect()}
    assert out[0]["temperature"] == 70.5
    assert (out[1]["rpm"], out[1]["egt"], out[1]["machine_id"], out[1]["timestamp"].hour) == (900.0, 700.0, "T1", 10)
    assert [out[i]["machine_id"] for i in (2, 3, 4)] == ["mqtt-asset", "M-7", "mqtt-asset"]
    # Small values are bar only where the packet is aviation.
    assert out[5]["oil_pressure"] == 4.0
    assert (out[6]["machine_id"], out[6]["cht"], out[6]["manifold_pressure"], out[6]["throttle"]) == ("7", 180.0, 30.0, 55.0)
    assert 7 not in out and [r["i"] for r in payload.undecodable(df).collect()] == [7]
    flown = canonical(spark, {"machine_id": "M", "oil_pressure": 4.0}, pack="aviation_uav_piston")
    assert flown["oil_pressure"] == pytest.approx(58.015)


def test_round_trip_json(spark):
    row = spark.createDataFrame([("U", NOW, 1.5, None)], "machine_id string, timestamp timestamp, egt double, cht double")
    text = json.loads(payload.publisher_json(row).first()["value"])
    assert text == {"timestamp": "2026-01-01T00:00:00", "uav_id": "U", "machine_id": "U", "egt": 1.5}
    assert payload.flight_log(row.withColumn("raw", F.lit("x"))).columns == row.columns


def test_file_stream_payload_equals_batch(spark, sf, tmp_path):
    msgs = messages(spark, sf).select("topic", "value").persist()
    msgs.repartition(3).write.json(str(tmp_path / "in"))
    rows = payload.canonical_rows(sources.message_file_stream(spark, str(tmp_path / "in")), topic="topic", arrived="arrived")
    q = sources.write_log(rows, str(tmp_path / "log"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    fields = ["machine_id", "temperature", "rpm", "egt", "oil_pressure", "pressure"]
    batch = payload.canonical_rows(msgs.withColumn("arrived", F.current_timestamp()), topic="topic", arrived="arrived")
    log = spark.read.parquet(str(tmp_path / "log"))
    assert log.count() == batch.count()
    assert log.select(fields).exceptAll(batch.select(fields)).count() == 0


def test_csv_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.csv").write_text(f"machine_id,temperature\nA,{i}\nB,{i}\n")
    df = sources.csv_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], "machine_id string, temperature double").schema)
    q = df.writeStream.format("memory").queryName("increments").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("increments").count() == 6


def test_status_stream_equals_batch(spark, sf, tmp_path):
    scored = v.scored(v.readings(spark, sf)).select(
        "machine_id", "timestamp", "event_id", "temperature", "vibration", "pressure", "rpm", "oil_pressure", "is_anomaly"
    ).persist()
    # Two files, the later rows first: late data must not move the newest row backwards.
    scored.filter("event_id % 2 = 1").coalesce(1).write.parquet(str(tmp_path / "in" / "a"))
    scored.filter("event_id % 2 = 0").coalesce(1).write.parquet(str(tmp_path / "in" / "b"))
    stream = spark.readStream.schema(scored.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    out = status.live_status_stream(stream, tail=20, stale_after=3600)
    got = {}

    def keep(batch, _):
        for r in batch.collect():
            got[r["machine_id"]] = r

    q = out.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).foreachBatch(keep).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    want = {r["machine_id"]: r for r in status.live_status(scored, NOW, tail=20).collect()}
    assert set(got) == set(want)
    for asset, row in want.items():
        for field in ("risk_level", "anomaly_rate_pct", "predicted_rul_days", "health_index", "go_nogo", "physics_fault",
                      "advisory", "n_rows", "last_temperature", "last_oil_pressure"):
            assert got[asset][field] == row[field], (asset, field)


def test_batch_status_order_and_model_days(spark):
    rows = [(i, NOW, "calm" if i % 2 else "stressed", 70.0 if i % 2 else 130.0, 1.0, i % 2 == 0) for i in range(40)]
    df = spark.createDataFrame(rows, ["event_id", "timestamp", "machine_id", "temperature", "vibration", "is_anomaly"])
    out = status.live_status(df, NOW).orderBy(*status.status_order()).collect()
    assert [r["machine_id"] for r in out] == ["stressed", "calm"]
    assert out[0]["risk_level"] == "High" and out[0]["health_index"] == 16.0 and out[1]["risk_level"] == "Low"
    model = spark.createDataFrame([("calm", 9)], ["machine_id", "predicted_rul_days"])
    days = {r["machine_id"]: r["predicted_rul_days"] for r in status.live_status(df, NOW, predictions=model).collect()}
    assert days["calm"] == 9


def test_physics_rules_work_on_a_stream(spark, sf, tmp_path):
    from rivetwatch.operators.physics import apply_physics_rules

    df = v.readings(spark, sf)
    df.write.parquet(str(tmp_path / "in"))
    out = apply_physics_rules(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = out.select("event_id", "physics_rule").writeStream.format("memory").queryName("red").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = apply_physics_rules(df).select("event_id", "physics_rule")
    assert spark.table("red").exceptAll(batch).count() == 0 and spark.table("red").count() == df.count()


def test_keys_can_be_renamed(spark):
    df = spark.createDataFrame([(1, NOW, "A", 130.0)], ["n", "at", "asset", "temperature"])
    row = status.live_status(df, NOW, keys=Keys("asset", "at", "n")).first()
    assert row["asset"] == "A" and row["physics_fault"] == "Overheating"


def test_efi_status_and_hand_off(spark):
    from rivetwatch.plans.pipeline import hand_off

    df = spark.createDataFrame([("E1", 5100.0, None, 61.0, 40.0)], "ecu_index string, rpm double, engine_load double, throttle_position double, intake_temperature double")
    row = payload.efi_status_rows(df).first()
    assert (row["machine_id"], row["rpm"], row["throttle"], row["temperature"]) == ("E1", 5100.0, 61.0, 40.0)
    log = spark.createDataFrame([(json.dumps({"uav_id": "U1", "temperature": 60 + i, "vibration": None if i == 2 else 1.0 + i, "timestamp": f"2026-01-01T00:0{i}:00Z"}), NOW) for i in range(5)],
                                "value string, arrived timestamp")
    rows = hand_off(payload.canonical_rows(log, arrived="arrived")).orderBy("timestamp").collect()
    assert len(rows) == 5 and "raw" not in rows[0].asDict()
    assert [r["vibration"] for r in rows][1:3] == [2.0, 2.0]
