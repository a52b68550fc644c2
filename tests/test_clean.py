from __future__ import annotations

from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from rivetwatch.functions.columns import find_col, nan_to_null
from rivetwatch.operators import clean, mapping


def test_trim_names_keeps_first_duplicate(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["a", "b", "c"]).toDF(" x", "x ", "y")
    out = clean.trim_names(df)
    assert out.columns == ["x", "y"] and out.first()["x"] == 1


def test_sentinels_fuse_after_dedupe(spark):
    df = spark.createDataFrame([("NA", "1"), ("", "1"), ("NA", "1")], ["a", "b"])
    out = clean.fuse_sentinels(clean.drop_duplicate_rows(df))
    assert out.count() == 2 and out.filter("a is null").count() == 2


def test_type_plan(spark):
    rows = [("1", "x", "2024-01-01", "20240101")] * 8 + [("bad", "y", "nope", "20240102")] * 2
    df = spark.createDataFrame(rows, ["num", "txt", "read_date", "day_code"])
    plan = clean.plan_types(df)
    # Digits in a date-named column are numbers first.
    assert plan == (["num", "day_code"], ["read_date"])
    typed = clean.apply_types(df, plan)
    assert dict(typed.dtypes) == {"num": "double", "txt": "string", "read_date": "timestamp", "day_code": "double"}
    assert typed.filter("num is null").count() == 2


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], ["x"])
    assert nan_to_null(df).filter("x is null").count() == 1


def test_winsorize_guard(spark):
    df = spark.createDataFrame([(5.0,)] * 9 + [(50.0,)], ["x"])
    assert clean.winsorize(df, ["x"]).agg({"x": "max"}).first()[0] == 50.0
    assert clean.winsorize(df, ["x"], guard_zero_iqr=False).agg({"x": "max"}).first()[0] == 5.0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False), min_size=4, max_size=30))
def test_winsorize_stays_in_its_bounds(spark, values):
    df = spark.createDataFrame([(v,) for v in values], ["x"])
    lo, hi = df.selectExpr("percentile(x, 0.25) a", "percentile(x, 0.75) b").first()
    reach = 1.5 * (hi - lo)
    for r in clean.winsorize(df, ["x"]).collect():
        assert reach == 0 or lo - reach - 1e-6 <= r["x"] <= hi + reach + 1e-6


def test_regression_and_median_imputation(spark):
    t = [datetime(2024, 1, 1, h) for h in range(7)]
    rows = [(i, "A", t[i], None if i == 3 else 10.0 + 2 * i) for i in range(7)]
    rows += [(10, "B", t[0], 1.0), (11, "B", t[1], None)]
    df = spark.createDataFrame(rows, "event_id long, machine_id string, timestamp timestamp, x double")
    out = {r["event_id"]: r["x"] for r in clean.regression_impute(df, ["x"]).collect()}
    assert out[3] == pytest.approx(16.0)
    assert out[11] == pytest.approx(df.selectExpr("percentile(x, 0.5) m").first()["m"])


def test_mode_tie_and_empty(spark):
    df = spark.createDataFrame([("b", None), ("a", None), (None, None)], "x string, y string")
    rows = clean.mode_impute(df, ["x", "y"]).collect()
    assert [r["x"] for r in rows] == ["b", "a", "a"] and {r["y"] for r in rows} == {"Unknown"}


def test_quantile_bins_merge_equal_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 1, 1, 1, 1, 1, 2, 3, 4, 5]], ["x"])
    out = clean.quantile_bin(df, ["x"], q=4).collect()
    assert {r["x_bin_idx"] for r in out} == {0, 1}
    assert out[0]["x_bin"].startswith("(1.000, ")


def test_clean_sensor_data_fills_per_asset_first(spark):
    t = [datetime(2024, 1, 1, h) for h in range(3)]
    rows = [(1, " A", t[0], "70"), (2, "A", t[1], "bad"), (3, "B", t[0], None), (4, "B", t[1], "90"), (5, "B", None, "1")]
    df = spark.createDataFrame(rows, "event_id long, machine_id string, timestamp timestamp, temperature string")
    out = {r["event_id"]: (r["machine_id"], r["temperature"]) for r in clean.clean_sensor_data(df).collect()}
    # Forward fill, then the fleet median, then the cap at 75 + 1.5 * 5.
    assert out == {1: ("A", 70.0), 2: ("A", 70.0), 3: ("B", 70.0), 4: ("B", 82.5)}


def test_industrial_clean_runs_in_order(spark, sf):
    from rivetwatch.plans import sensor_view as v

    df = v.as_text(v.readings(spark, sf))
    out = clean.industrial_clean(df)
    assert {"temperature_bin", "temperature_smooth", "vibration_smooth"} <= set(out.columns)
    assert out.filter("temperature is null").count() == 0
    assert dict(out.dtypes)["timestamp"] == "timestamp"


# ---------------------------------------------------------------- mapping
def test_messy_headers():
    m = mapping.suggest_mapping(["asset_id", "temp_c", "vib", "rul_days"])
    assert m["machine_id"] == "asset_id" and m["temperature"] == "temp_c" and m["failure_within_days"] == "rul_days"


def test_extras_do_not_steal_core():
    cols = ["time", "uav_id", "temp_c", "vib", "press_psi", "egt_c", "oil_psi"]
    m = mapping.suggest_mapping(cols, "aviation_uav_piston")
    wanted = ["timestamp", "machine_id", "temperature", "vibration", "pressure", "egt", "oil_pressure"]
    assert [next(k for k, s in m.items() if s == c) for c in cols] == wanted


def test_apply_mapping_leaves_existing_target(spark):
    df = spark.createDataFrame([(1, 2)], ["temp", "temperature"])
    assert mapping.apply_mapping(df, {"temperature": "temp"}).columns == ["temp", "temperature"]


def test_detect_gate(spark):
    assert not mapping.can_detect(spark.createDataFrame([(1, 2)], ["foo", "bar"]))
    assert mapping.can_detect(spark.createDataFrame([(1, 2)], ["temperature", "vibration"]))
    with pytest.raises(ValueError):
        mapping.require_detectable(spark.createDataFrame([(1,)], ["foo"]))


@pytest.mark.parametrize("columns,ids,pack", [
    (["egt", "cht", "machine_id"], ["UAV-01"], "aviation_uav_piston"),
    (["coolant_temp", "engine_load", "machine_id"], ["ENG-01"], "automotive_powertrain"),
    (["polish_rod_load", "pump_fillage", "machine_id"], ["WELL-01"], "oil_srp"),
    (["vibration", "rpm", "machine_id"], ["Machine 1"], "plant_rotating"),
    (["foo", "machine_id"], ["zz"], "plant_rotating"),
])
def test_pack_suggestion(spark, columns, ids, pack):
    df = spark.createDataFrame([tuple(ids[0] if c == "machine_id" else 1.0 for c in columns)], columns)
    assert mapping.suggest_pack(df) == pack


def test_find_col_does_not_confuse_labels():
    assert find_col(["failure_within_days", "physics_fault"], "failure", "fault") is None
    assert find_col(["Temp_C"], "temperature", "temp") == "Temp_C"


def test_clean_wide_looks_for_copies_once(spark, tmp_path):
    rows = [(i % 40, float(i % 40), None if i % 40 == 7 else float(i % 5)) for i in range(80)]
    spark.createDataFrame(rows, "event_id long, vibration double, oil_pressure double").write.parquet(f"{tmp_path}/given")
    out = clean.clean_wide(spark.read.parquet(f"{tmp_path}/given"))
    assert out.count() == 40 and out.filter("oil_pressure IS NULL").isEmpty()
    assert not any("/given/" in f for f in out.inputFiles())
