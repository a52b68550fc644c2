from __future__ import annotations

from pyspark.sql import functions as F

from rivetwatch.operators import quality
from rivetwatch.plans import sensor_view as v
from rivetwatch.plans.pipeline import clean_and_quality, run_reliability


def test_clean_and_quality(spark, sf):
    df = v.with_gaps(v.readings(spark, sf))
    cleaned, report = clean_and_quality(df)
    rows = {r["check"]: tuple(r)[:4] for r in report.collect()}
    assert set(rows) == set(quality.STAGES)
    assert cleaned.filter("temperature is null or vibration is null").isEmpty() and cleaned.count() == df.count()
    few = clean_and_quality(df, checks=["NULLS", "IQR"])[1].collect()
    assert {r["check"] for r in few} == {"NULLS", "IQR"} and all(tuple(r)[:2] == rows[r["check"]][:2] for r in few)
    assert clean_and_quality(df, run_quality=False)[1] is None


def test_run_from_messy_headers_to_advice(spark, sf):
    df = v.with_gaps(v.readings(spark, sf)).filter("machine_id < 'M-0012'")
    messy = df.withColumnsRenamed({"machine_id": "Asset ID", "temperature": "Temp C", "vibration": "RMS-Vib"})
    run = run_reliability(messy, trees=20, rul_trees=3)
    assets = {r["machine_id"]: r for r in run.assets.collect()}
    assert set(assets) == {f"M-{i:04d}" for i in range(12)} & {r[0] for r in df.select("machine_id").distinct().collect()}
    lives = {r["machine_id"]: r for r in run.predictions.collect()}
    for name, a in assets.items():
        assert a["risk_level"] == lives[name]["risk_level"] and 0 <= a["health_index"] <= 100
        wanted = "CAUTION" if a["advisory"].startswith("Monitor") else "NO-GO" if a["advisory"].startswith(("Inspect", "Check")) else None
        assert wanted is None or a["go_nogo"] == wanted
    share = run.scored.agg(F.avg(F.col("is_anomaly").cast("double"))).first()[0]
    assert 0 < share < 0.2 and run.scored.count() == df.count()
    assert {r["machine_id"] for r in run.bundle.items.select("machine_id").collect()} == set(assets)
    assert run.brief.filter("section = 2").count() == 1 and run.kpis.count() >= 3
