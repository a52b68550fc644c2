"""Remaining life in the stream: the flat forest equals the fitted one, the stream equals the batch."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rivetwatch.operators import rul
from rivetwatch.plans import sensor_view as v
from rivetwatch.streaming import life


@pytest.fixture(scope="module")
def readings(spark, sf):
    df = v.with_gaps(v.with_life(v.readings(spark, sf)), every=5)
    return df.select("machine_id", "timestamp", "event_id", rul.LABEL, *life.sensors_of(df)).persist()


@pytest.fixture(scope="module")
def model(readings):
    return rul.fit_rul(rul.rul_features(readings), trees=12, depth=5)


@pytest.fixture(scope="module")
def forest(spark, model):
    return life.flatten(spark, model.model)


def test_flat_forest_equals_the_model(spark, readings, model, forest):
    rows = model.predict(rul.rul_features(readings)).select("features", "prediction").collect()
    x = np.array([r["features"].toArray() for r in rows])
    assert len(forest.roots) == 12
    assert np.allclose(forest.predict(x), [r["prediction"] for r in rows], rtol=0, atol=1e-9)
    assert len(forest.predict(x[:0])) == 0


def test_newest_features_equal_the_windows(readings, model):
    want = {r["machine_id"]: r["predicted_rul_days"] for r in rul.predict_latest(model, rul.rul_features(readings)).collect()}
    got = {r["machine_id"]: r["predicted_rul_days"] for r in life.live_life(readings, model).collect()}
    assert got == want


def test_other_features_are_refused(spark, model):
    wrong = rul.RulModel(model.model, [*model.features, "humidity"], {}, False, "")
    with pytest.raises(ValueError):
        life._model_sensors(wrong)


def test_stream_with_late_rows_and_a_restart_equals_batch(spark, readings, model, forest, tmp_path):
    rows = readings.drop(rul.LABEL)
    # The newest rows come first, the oldest last, in four files; the query stops in between and starts again.
    for i, part in enumerate((rows.filter("event_id % 4 = 3"), rows.filter("event_id % 4 = 1"), rows.filter("event_id % 4 = 2"), rows.filter("event_id % 4 = 0"))):
        part.orderBy(F.col("timestamp").desc()).coalesce(1).write.parquet(str(tmp_path / f"all/{i}"))
    (tmp_path / "in").mkdir()
    newest = {}

    def keep(batch, _):
        for r in batch.collect():
            newest[r["machine_id"]] = (r["last_ts"], r["predicted_rul_days"])

    def run():
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
        q = life.live_life_stream(stream, model, forest=forest).writeStream.outputMode("update")
        q = q.option("checkpointLocation", str(tmp_path / "ck")).foreachBatch(keep).trigger(availableNow=True).start()
        q.awaitTermination(180)
        assert q.exception() is None

    for i in (0, 1):
        (tmp_path / f"all/{i}").rename(tmp_path / f"in/{i}")
    run()
    for i in (2, 3):
        (tmp_path / f"all/{i}").rename(tmp_path / f"in/{i}")
    run()
    want = {r["machine_id"]: (r["last_ts"], r["predicted_rul_days"]) for r in life.live_life(rows, model, forest=forest).collect()}
    assert newest == want
