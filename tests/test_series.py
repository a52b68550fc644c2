"""Sliced windows give the same rows as plain ones, also when one asset is most of the table."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rivetwatch.functions.columns import Keys
from rivetwatch.functions.quantiles import quantiles
from rivetwatch.operators import series
from rivetwatch.plans import sensor_view as v

PLAIN = series.SeriesProfile(0, 0, 0, None)


@pytest.fixture(scope="module")
def skewed(spark, sf):
    df = v.with_gaps(v.readings(spark, sf), every=3)
    # Two thirds of the rows belong to one asset.
    return df.withColumn("machine_id", F.when(F.col("event_id") % 3 < 2, "HOT").otherwise(F.col("machine_id")))


@pytest.mark.parametrize("seconds", [600.0, 86_400.0, 10 * 86_400.0])
def test_sliced_windows_equal_plain(skewed, seconds):
    exprs = {"m": series.rolling_mean("temperature", 24), "s": series.rolling_std("vibration", 24), "d": series.step("rpm")}

    def run(profile):
        out = series.add_windowed(skewed, exprs, 23, profile=profile)
        return {r["event_id"]: tuple(None if r[c] is None else round(r[c], 8) for c in exprs) for r in out.collect()}

    assert run(PLAIN) == run(series.SeriesProfile(0, 0, 0, seconds))


@pytest.mark.parametrize("seconds", [600.0, 86_400.0])
def test_sliced_forward_fill_equals_plain(skewed, seconds):
    cols = ["temperature", "vibration"]

    def run(profile):
        out = series.forward_fill(skewed, cols, profile=profile)
        return {r["event_id"]: (r["temperature"], r["vibration"]) for r in out.collect()}

    assert run(PLAIN) == run(series.SeriesProfile(0, 0, 0, seconds))


def test_profile_slices_only_hot_assets(skewed):
    calm = series.profile_series(skewed)
    assert calm.slice_seconds is None and calm.rows == skewed.count()
    hot = series.profile_series(skewed, target_rows=50)
    assert hot.slice_seconds is not None
    biggest = skewed.groupBy("machine_id", series._slice_index(Keys(), hot.slice_seconds)).count().agg(F.max("count")).first()[0]
    assert biggest <= 100


def test_windows_share_one_exchange(skewed):
    exprs = {"m": series.rolling_mean("temperature", 24), "d": series.step("temperature")}
    plan = series.add_windowed(skewed, exprs, 23, profile=PLAIN)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_latest_is_independent_of_partitioning(skewed):
    one = {tuple(r) for r in series.latest_per_asset(skewed, ["event_id"]).collect()}
    many = {tuple(r) for r in series.latest_per_asset(skewed.repartition(13), ["event_id"]).collect()}
    assert one == many


@pytest.mark.parametrize("by", [[], ["machine_id"]])
def test_bracket_quantiles_are_exact(skewed, by):
    cols, probs = ["temperature", "vibration"], [0.0, 0.2, 0.25, 0.5, 0.9, 1.0]

    def run(method):
        out = quantiles(skewed, cols, probs, by, method=method).collect()
        return {tuple(r[b] for b in by): [np.round(r[c], 9).tolist() for c in cols] for r in out}

    assert run("direct") == run("bracket")


def test_bracket_quantiles_use_the_sketch_on_larger_columns(spark):
    df = spark.range(60_000).select((F.pow(F.rand(7), F.lit(4)) * 1000).alias("x"))
    df = df.unionByName(spark.range(20_000).select(F.lit(5.0).alias("x"))).persist()
    a = quantiles(df, ["x"], [0.1, 0.5, 0.99], method="direct").first()["x"]
    b = quantiles(df, ["x"], [0.1, 0.5, 0.99], method="bracket").first()["x"]
    assert np.allclose(a, b, rtol=1e-12)


def test_salted_lookup_equals_a_plain_join(skewed, monkeypatch):
    small = skewed.groupBy("machine_id").agg(F.max("temperature").alias("top"))
    monkeypatch.setattr(series, "TARGET_ROWS", 30)
    salted = series.salted_lookup(skewed, small, "machine_id", 700)
    plain = skewed.join(small, "machine_id")
    assert salted.count() == plain.count() == skewed.count()
    assert salted.select("event_id", "top").exceptAll(plain.select("event_id", "top")).count() == 0


def test_sliced_windows_spread_a_table_hashed_by_asset(skewed):
    """Even when the input is partitioned by asset, the sliced plan moves rows by (asset, slice)."""
    hashed = skewed.repartition(4, "machine_id")
    out = series.add_windowed(hashed, {"d": series.step("rpm")}, 1, profile=series.SeriesProfile(0, 0, 0, 600.0))
    plan = out._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning(machine_id" in line and "__slice" in line]
    assert moved


def test_only_hot_assets_are_cut(spark):
    """One asset of 40,000 rows beside 200 of 100: the small ones get no context rows, and results stay the same."""
    hot = spark.range(40_000).select(F.lit("HOT").alias("machine_id"), F.col("id").alias("event_id"))
    cold = spark.range(20_000).select(F.concat(F.lit("A"), F.col("id") % 200).alias("machine_id"), (F.col("id") + 40_000).alias("event_id"))
    df = hot.union(cold).withColumn("timestamp", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("event_id") % 40_000)).withColumn("x", F.sin("event_id"))
    profile = series.profile_series(df, target_rows=400)
    assert [a for a, _ in profile.hot] == ["HOT"]
    cut = series._slices(df, Keys(), profile)
    context = series._context_rows(cut, 23, Keys())
    assert context.filter("machine_id <> 'HOT'").count() == 0
    assert context.count() + df.count() < 1.1 * df.count() + 23 * 200
    assert cut.filter("machine_id = 'HOT'").groupBy("__slice").count().agg(F.max("count")).first()[0] <= 800
    exprs = {"m": series.rolling_mean("x", 24)}

    def run(p):
        return {r.event_id: round(r.m, 9) for r in series.add_windowed(df, exprs, 23, profile=p).collect()}

    assert run(profile) == run(PLAIN)
    gaps = df.withColumn("x", F.when(F.col("event_id") % 7 == 0, F.col("x")))
    filled = [{r.event_id: r.x for r in series.forward_fill(gaps, ["x"], profile=p).collect()} for p in (profile, PLAIN)]
    assert filled[0] == filled[1]


def test_bracket_quantiles_of_a_whole_table_are_looked_up_not_run_again(spark):
    x = F.when(F.col("id") != 59_999, (F.col("id") * 7919 % 60_000).cast("double"))
    df = spark.range(60_000).select(x.alias("x"), (F.col("id") % 3).cast("double").alias("y"), F.lit(None).cast("double").alias("z"))
    probs = [0.0, 0.2, 0.25, 0.5, 0.75, 0.95, 1.0]
    got = quantiles(df, ["x", "y"], probs, method="bracket")
    assert "Range" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.collect() == quantiles(df, ["x", "y"], probs, method="direct").collect()
    assert quantiles(df, ["z"], [0.25, 0.5], method="bracket").first()["z"] == [None, None]
