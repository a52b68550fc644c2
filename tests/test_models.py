"""Properties of the learned operators, and exact density results against brute force."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rivetwatch.operators import iforest, quality, rul
from rivetwatch.operators.density import _Blocks, components, dbscan
from rivetwatch.plans import sensor_view as v


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (600, 3))
    x[0] = [9, -9, 9]
    pdf = pd.DataFrame(x, columns=["temperature", "vibration", "pressure"])
    pdf["event_id"] = range(len(pdf))
    return spark.createDataFrame(pdf).persist()


def test_forest_ranks_the_planted_outlier_first(planted):
    model = iforest.fit_forest(planted, contamination=0.05)
    scored = model.annotate(planted)
    top = scored.orderBy(F.col("anomaly_score").desc()).first()
    assert top["event_id"] == 0
    low, high, flagged = scored.agg(F.min("anomaly_score"), F.max("anomaly_score"), F.count_if("is_anomaly")).first()
    assert 0 < low <= high <= 1 and abs(flagged - 30) <= 1


def test_forest_does_not_depend_on_partitioning(planted):
    a = iforest.fit_forest(planted, trees=20).annotate(planted)
    b = iforest.fit_forest(planted.repartition(11), trees=20).annotate(planted)
    assert [r[0] for r in a.orderBy("event_id").select("anomaly_score").collect()] == [
        r[0] for r in b.orderBy("event_id").select("anomaly_score").collect()
    ]


def test_forest_sample_is_bounded_on_a_large_table(spark):
    df = spark.range(300_000).select(F.col("id").alias("event_id"), F.rand(1).alias("temperature"))
    drawn = iforest._draw(df, "event_id", 300_000, 100, 256, 42).groupBy("tree").count()
    row = drawn.agg(F.max("count"), F.min("count"), F.count("tree")).first()
    assert row[0] <= 256 and row[1] > 200 and row[2] == 100


def test_forest_fills_missing_and_rejects_bad_settings(planted):
    holes = planted.withColumn("vibration", F.when(F.col("event_id") % 2 == 0, F.col("vibration")))
    assert iforest.fit_forest(holes, trees=10).annotate(holes).filter("anomaly_score is null").count() == 0
    with pytest.raises(ValueError):
        iforest.fit_forest(planted, contamination=0.0)
    with pytest.raises(ValueError):
        iforest.fit_forest(planted.select("event_id"))


def test_rul_learns_and_predicts_per_asset(spark, sf):
    df = v.readings(spark, sf).withColumn("failure_within_days", 140 - F.col("temperature"))
    featured = rul.rul_features(df)
    model = rul.fit_rul(featured, trees=10, depth=6)
    assert not model.is_proxy and model.metrics["r2"] > 0.9
    assert model.importances(spark).first()["feature"] in {"temperature", "pressure", "oil_pressure"}
    out = rul.predict_latest(model, featured)
    assert out.count() == df.select("machine_id").distinct().count()
    assert out.filter("predicted_rul_days < 1").count() == 0


def test_rul_falls_back_to_proxy_labels(spark, sf):
    model = rul.fit_rul(rul.rul_features(v.readings(spark, sf)), trees=5, depth=4)
    assert model.is_proxy and model.label_source == "synthetic_degradation_proxy"


def test_rul_search_picks_a_model(spark, sf):
    featured = rul.rul_features(v.with_life(v.readings(spark, sf)))
    best = rul.tune_rul(featured, trials=2, folds=2, max_trees=5, seed=3)
    assert best["best_model"] in {"RandomForest", "GradientBoosting"} and best["rmse_cv"] > 0
    assert best["mae"] <= best["rmse"] and best["r2"] <= 1
    rows = rul.search_rows(spark, best).collect()
    assert [r["rung"] for r in rows] == [0, 0, 1, 2] and [r["best"] for r in rows] == [False, False, False, True]
    with pytest.raises(ValueError):
        rul.tune_rul(featured.drop("failure_within_days"))


# ---------------------------------------------------------------- density
def brute_force(x, eps=0.8, min_pts=5):
    z = (x - x.mean(0)) / np.where(x.std(0) == 0, 1, x.std(0))
    near = np.sqrt(((z[:, None] - z[None]) ** 2).sum(-1)) <= eps
    core = near.sum(1) >= min_pts
    label, clusters = np.full(len(x), -1), 0
    for i in range(len(x)):
        if core[i] and label[i] < 0:
            stack, label[i] = [i], clusters
            while stack:
                for k in np.flatnonzero(near[stack.pop()]):
                    if label[k] < 0:
                        label[k] = clusters
                        if core[k]:
                            stack.append(k)
            clusters += 1
    return int((label < 0).sum()), int(core.sum()), clusters


@pytest.mark.parametrize("seed,n,d", [(7, 160, 6), (1, 240, 2), (2, 320, 3), (3, 400, 4), (5, 240, 12)])
def test_dbscan_equals_brute_force(spark, seed, n, d):
    rng = np.random.default_rng(seed)
    x = np.concatenate([
        rng.normal(0, 0.25, (n // 2, d)), rng.normal(3, 0.3, (n // 4, d)), rng.uniform(-6, 8, (n // 4, d)),
        np.repeat([[9.0] * d], n // 3, axis=0),  # copies of one point: a third of the table
    ])
    df = spark.createDataFrame(pd.DataFrame(x, columns=[f"c{i}" for i in range(d)]))
    row = dbscan(df, list(df.columns)).first()
    assert (row["noise_points"], row["core_points"], row["clusters"]) == brute_force(x)


def test_dbscan_of_one_point_and_of_no_row(spark):
    same = spark.createDataFrame([(1.0, -2.0)] * 7, "a double, b double")
    assert tuple(dbscan(same, ["a", "b"]).first()) == (7, 0, 7, 1)
    assert tuple(dbscan(same.filter("a > 5"), ["a", "b"]).first()) == (0, 0, 0, 0)


@pytest.mark.parametrize("d,block,region", [(12, 16, 48), (3, 4, 16), (2, 512, 40)])
def test_dbscan_in_small_blocks_and_regions(spark, d, block, region):
    """Counts, noise and clusters cross many blocks and regions; rows are made by pairs of blocks, not of points or cells."""
    rng = np.random.default_rng(d)
    spread = 0.12 if d == 12 else 0.3
    line = np.linspace(-4, 4, 240)[:, None] * np.ones(d) + rng.normal(0, spread / 2, (240, d))  # one long cluster over many blocks
    x = np.concatenate([line, rng.normal(0, spread, (60, d)) + np.where(np.arange(d) % 2, 3.0, -3.0), rng.uniform(-5, 5, (60, d)), np.repeat(line[:3], 3, axis=0)])
    df = spark.createDataFrame(pd.DataFrame(x, columns=[f"c{i}" for i in range(d)]))
    row = dbscan(df, list(df.columns), block=block, region=region).first()
    assert (row["noise_points"], row["core_points"], row["clusters"]) == brute_force(x)
    g = _Blocks(df, list(df.columns), 0.8, 5, block, region)
    blocks = g.blocks.count()
    assert 1 < blocks < 360 and g.pairs.count() <= blocks * (blocks - 1)
    assert g.blocks.selectExpr("sum(aggregate(w, 0L, (t, v) -> t + v))").first()[0] == len(x)


def test_components(spark):
    nodes = spark.createDataFrame([(str(i),) for i in range(10)], ["id"])
    edges = spark.createDataFrame([(str(i), str(i + 1)) for i in range(6)] + [("8", "9")], ["a", "b"])
    labels = {r["id"]: r["label"] for r in components(nodes, edges).collect()}
    assert len({labels[str(i)] for i in range(7)}) == 1 and labels["8"] == labels["9"] and labels["7"] == "7"


# ---------------------------------------------------------------- quality
def test_quality_report_has_nineteen_rows(spark, sf):
    df = v.with_gaps(v.readings(spark, sf))
    rows = quality.quality_report(df).collect()
    assert len(rows) == 19 and {r["status"] for r in rows} <= {"PASS", "WARN", "FAIL", "INFO"}
    assert set(quality.STAGES) == {r["check"] for r in rows}


def test_report_core_scans_twice(spark, sf):
    df = v.with_gaps(v.readings(spark, sf))
    stages = ["NULLS", "CONSTANT", "ZEROS", "Z-SCORE", "SCHEMA / ROWCOUNT"]
    plan = quality.run_stages(df, stages)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") <= 3


def test_small_tables_give_info(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0)], ["event_id", "temperature", "vibration"]).withColumn("timestamp", F.current_timestamp())
    assert quality.forest_stage(df).first()["status"] == "INFO"
    assert quality.kmeans_stage(df).first()["status"] == "INFO"
    assert quality.pca_stage(df).first()["status"] == "INFO"


def test_pca_drift_sees_a_structural_change(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=(400, 5))
    b = np.repeat(rng.normal(size=(400, 1)), 5, axis=1) + rng.normal(scale=0.01, size=(400, 5))
    pdf = pd.DataFrame(np.concatenate([a, b]), columns=[f"s{i}" for i in range(5)])
    pdf["timestamp"] = pd.date_range("2024-01-01", periods=800, freq="h")
    pdf["event_id"] = range(800)
    row = quality.pca_stage(spark.createDataFrame(pdf)).first()
    assert row["status"] == "WARN" and row["metric"] > 0.3


def test_planted_quality_faults(spark):
    rows = [(i, f"2024-01-01 00:{i:02d}:00", "A", 70.0 if i != 20 else 160.0, 0.05 if i == 20 else 1.0 + i / 100, 0, 5.0) for i in range(40)]
    df = spark.createDataFrame(rows, ["event_id", "timestamp", "machine_id", "temperature", "vibration", "failure", "flat"])
    df = df.withColumn("timestamp", F.to_timestamp("timestamp"))
    out = {r["check"]: r for r in quality.run_stages(df, ["CONSTANT", "IMPOSSIBLE JUMP", "DOMAIN RULES"]).collect()}
    assert "flat" in out["CONSTANT"]["detail"] and out["CONSTANT"]["status"] == "FAIL"
    assert out["IMPOSSIBLE JUMP"]["metric"] == 2 and out["IMPOSSIBLE JUMP"]["status"] == "FAIL"
    assert "1 hot rows without vibration" in out["DOMAIN RULES"]["detail"]


def test_forest_histograms_leave_room_in_an_executor(spark, sf, monkeypatch):
    """Four tasks hold their histograms at once in some 6 GB of heap; less room takes more passes and gives the same forest."""
    made, plain = [], rul.RandomForestRegressor
    monkeypatch.setattr(rul, "RandomForestRegressor", lambda **o: made.append(plain(**o)) or made[-1])
    featured = rul.rul_features(v.with_life(v.readings(spark, sf)))
    small = rul.fit_rul(featured, trees=3, depth=6)
    assert 4 * made[0].getMaxMemoryInMB() <= 1024
    assert 4 * rul._regressor("RandomForest", {"trees": 9, "depth": 20, "leaf": 1}, 1.0, 1).getMaxMemoryInMB() <= 1024
    monkeypatch.setattr(rul, "HISTOGRAM_MB", 1)
    tight = rul.fit_rul(featured, trees=3, depth=6)
    assert tight.metrics == small.metrics
    assert np.allclose(tight.model.featureImportances.toArray(), small.model.featureImportances.toArray())
