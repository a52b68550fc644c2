"""Windows over a table without keys: sliced results equal one-task windows, and slices are of one size."""

from __future__ import annotations

import pytest
from pyspark.sql import Window, functions as F

from rivetwatch.functions.columns import Keys
from rivetwatch.operators import rul, series, whole
from rivetwatch.plans import sensor_view as v

ORDER = ["timestamp", "event_id"]


@pytest.fixture(scope="module")
def rows(spark, sf):
    df = v.with_gaps(v.readings(spark, sf), every=3).drop("machine_id").filter("event_id % 3 > 0 or event_id % 5 = 0")
    # A third of all rows at one time, some without a time.
    at = F.when(F.col("event_id") % 3 == 1, F.lit("2024-01-05").cast("timestamp")).when(F.col("event_id") % 50 == 0, None).otherwise(F.col("timestamp"))
    return df.withColumn("timestamp", at).persist()


def values(df, cols):
    return {r["event_id"]: tuple(None if r[c] is None else round(r[c], 8) for c in cols) for r in df.collect()}


@pytest.mark.parametrize("size", [1, 7, 24, 100, 10**6])
def test_windows_equal_one_task(rows, size):
    exprs = {"m": series.rolling_mean("vibration", 24), "s": series.rolling_std("rpm", 24), "d": series.step("rpm")}
    w = Window.orderBy(*ORDER)
    want = values(rows.withColumns({k: e(w) for k, e in exprs.items()}), exprs)
    assert values(whole.add_windowed_whole(rows, exprs, 23, ORDER, size), exprs) == want


@pytest.mark.parametrize("size", [3, 64, 10**6])
def test_carried_values_equal_one_task(rows, size):
    w = Window.orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    filled = values(rows.withColumn("x", F.last("vibration", True).over(w)), ["x"])
    assert values(whole.forward_fill_whole(rows, ["vibration"], ORDER, size), ["vibration"]) == filled
    summed = values(rows.withColumn("x", F.sum(F.coalesce("rpm", F.lit(0))).over(w)), ["x"])
    got = values(whole.running_whole(rows, {"total": "rpm"}, ORDER, size), ["total"])
    assert got.keys() == summed.keys() and all(abs(got[k][0] - summed[k][0]) < 1e-4 for k in got)


def test_slices_are_of_one_size(rows):
    cut = whole._sliced(rows, ORDER, 50)
    sizes = [r["count"] for r in cut.groupBy(whole._SLICE).count().orderBy(whole._SLICE).collect()]
    assert set(sizes[:-1]) == {50} and sizes[-1] <= 50
    assert sorted(r[0] for r in cut.select(whole.POSITION).collect()) == list(range(rows.count()))


def test_rows_alike_and_no_rows(spark):
    same = spark.createDataFrame([(1, 2.0)] * 40, "event_id long, x double").withColumn("timestamp", F.lit("2024-01-01").cast("timestamp"))
    got = whole.running_whole(same, {"n": "x"}, ORDER, 7)
    assert sorted(r["n"] for r in got.collect()) == [2.0 * (i + 1) for i in range(40)]
    assert whole.add_windowed_whole(same.limit(0), {"m": series.rolling_mean("x", 3)}, 2, ORDER).collect() == []


def test_life_features_of_a_table_without_assets(rows):
    out = rul.rul_features(rows)
    w = Window.orderBy(*ORDER)
    want = values(rows.withColumn("m", F.avg("vibration").over(w.rowsBetween(-23, 0))), ["m"])
    assert values(out, ["vibration_roll_mean"]) == want
    assert Keys().id not in out.columns
