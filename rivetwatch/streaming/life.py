"""Remaining life from a fitted forest while readings arrive.

State per asset is the ring of its last rows in order of (timestamp, tie); late rows take their place in it.  Each update
gives the newest row's features (value, rolling mean, rolling deviation and change of every sensor), the same that the
batch form folds from a table.  Prediction is stateless: the fitted forest is flattened to arrays once, sent to the tasks
(its size is that of the model), and evaluated on whole Arrow batches, so a stream needs no pass over the table for it.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..constants import CORE_SENSORS, ROLLING_WINDOW
from ..functions.columns import Keys
from ..operators.rul import RulModel
from ..operators.series import last_rows
from ..session import checkpoint_dir

_KINDS = ("", "_roll_mean", "_roll_std", "_trend")


# ---------------------------------------------------------------- forest
class FlatForest(NamedTuple):
    """Trees laid one after the other: node -> feature (-1 in a leaf), cut, children, value."""

    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Mean over trees for each row of ``x``; all rows and trees go down one level at a time."""
        node = np.repeat(self.roots[None, :], len(x), axis=0)
        while True:
            feature = self.feature[node]
            inner = feature >= 0
            if not inner.any():
                return self.value[node].mean(axis=1) if len(self.roots) else np.zeros(len(x))
            held = np.take_along_axis(x, np.maximum(feature, 0), axis=1)
            down = np.where(held <= self.cut[node], self.left[node], self.right[node])
            node = np.where(inner, down, node)


def flatten(spark: SparkSession, model) -> FlatForest:
    """A fitted regression forest as arrays, read from the nodes of its saved form (public format, one row per node)."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/forest-{uuid.uuid4().hex}"
    model.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    if "nodeData" in nodes.columns:
        nodes = nodes.select("treeID", "nodeData.*")
    rows = nodes.select(
        "treeID", "id", "prediction", "leftChild", "rightChild", F.col("split.featureIndex").alias("feature"),
        F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("cut"),
    ).orderBy("treeID", "id").toPandas()  # as many as the model has nodes
    tree = rows["treeID"].to_numpy()
    roots = np.flatnonzero(np.append(True, tree[1:] != tree[:-1])) if len(rows) else np.empty(0, np.int64)
    base = np.repeat(roots, np.diff(np.append(roots, len(rows)))) if len(rows) else roots
    leaf = rows["leftChild"].to_numpy() < 0
    return FlatForest(
        roots, np.where(leaf, -1, rows["feature"].to_numpy()).astype(np.int64), rows["cut"].fillna(0.0).to_numpy(float),
        np.where(leaf, 0, base + rows["leftChild"].to_numpy()), np.where(leaf, 0, base + rows["rightChild"].to_numpy()), rows["prediction"].to_numpy(float),
    )


# ---------------------------------------------------------------- features of the newest row
def sensors_of(df: DataFrame) -> list[str]:
    return [c for c in CORE_SENSORS if c in df.columns]


def newest_features(df: DataFrame, sensors: list[str] | None = None, window: int = ROLLING_WINDOW, keys: Keys = Keys()) -> DataFrame:
    """Per asset: last_ts and the features of its newest row, from its last ``window`` rows alone (trimmed before the shuffle).

    Missing values take no part in means and deviations; a feature that can't be told is 0, as in training.
    """
    sensors = sensors or sensors_of(df)
    tail = last_rows(df.select(keys.id, keys.ts, keys.tie, *[F.col(c).cast("double").alias(c) for c in sensors]), window, keys)
    stamp = keys.stamp()
    newest = F.slice(F.sort_array(F.collect_list(F.struct(stamp.alias("at"), F.struct(*sensors).alias("x"))), asc=False), 1, 2)
    folded = tail.groupBy(keys.id).agg(
        F.max(keys.ts).alias("last_ts"), newest.alias("two"),
        *[F.avg(c).alias(f"{c}_roll_mean") for c in sensors], *[F.stddev_samp(c).alias(f"{c}_roll_std") for c in sensors],
    )
    one, two = F.get("two", F.lit(0))["x"], F.get("two", F.lit(1))["x"]
    out = folded.withColumns({c: one[c] for c in sensors} | {f"{c}_trend": one[c] - two[c] for c in sensors})
    names = [f"{c}{kind}" for c in sensors for kind in _KINDS]
    return out.select(keys.id, "last_ts", *[F.coalesce(F.col(n), F.lit(0.0)).alias(n) for n in names])


def predicted(features: DataFrame, forest: FlatForest, order: list[str], keys: Keys = Keys()) -> DataFrame:
    """(asset, last_ts, predicted_rul_days) of rows that hold the features ``order``; at least one day, halves to even."""
    shared = features.sparkSession.sparkContext.broadcast(forest)  # the size of the model, whatever the data

    def run(batches):
        for pdf in batches:
            x = pdf[order].to_numpy(float)
            days = np.maximum(1, np.round(shared.value.predict(x))).astype("int32") if len(x) else np.empty(0, "int32")
            yield pd.DataFrame({keys.id: pdf[keys.id], "last_ts": pdf["last_ts"], "predicted_rul_days": days})

    return features.mapInPandas(run, f"{keys.id} string, last_ts timestamp, predicted_rul_days int")


def live_life(df: DataFrame, model: RulModel, window: int = ROLLING_WINDOW, keys: Keys = Keys(), forest: FlatForest | None = None) -> DataFrame:
    """Remaining life of every asset of a table of readings, by the features of its newest row."""
    forest = forest or flatten(df.sparkSession, model.model)
    return predicted(newest_features(df, _model_sensors(model), window, keys), forest, model.features, keys)


def _model_sensors(model: RulModel) -> list[str]:
    known = [c for c in CORE_SENSORS if c in model.features]
    if set(model.features) - {f"{c}{kind}" for c in known for kind in _KINDS}:
        raise ValueError("live features are those of the core sensors and their windows; the model asks for others")
    return known


# ---------------------------------------------------------------- stream
def _trimmed(window: int):
    """Per task and batch: an asset's newest rows only, so a hot asset sends no more than ``window`` of them per task."""

    def trim(batches):
        for pdf in batches:
            pdf = pdf.sort_values(["timestamp", "tie"], kind="stable")
            newest = pdf.groupby("machine_id", sort=False).cumcount(ascending=False)
            yield pdf[newest < window]

    return trim


class RingProcessor(StatefulProcessor):
    """Last ``window`` rows of one asset in order; gives the newest row's features whenever rows arrive."""

    def __init__(self, sensors: list[str], window: int):
        self.sensors, self.window = sensors, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        arrays = ", ".join(f"c{i} array<double>" for i in range(len(self.sensors)))
        self.ring = handle.getValueState("ring", f"ts array<long>, tie array<long>, {arrays}")

    def handleInputRows(self, key, rows, timerValues):
        ring = None
        if self.ring.exists():
            ts, tie, *columns = self.ring.get()
            ring = pd.DataFrame({"ts": ts, "tie": tie, **dict(zip(self.sensors, columns))})
        for pdf in rows:
            fresh = pd.DataFrame({"ts": pdf["timestamp"].astype("datetime64[us]").astype("int64"), "tie": pdf["tie"], **{c: pdf[c].astype(float) for c in self.sensors}})
            joined = fresh if ring is None else pd.concat([ring, fresh], ignore_index=True)
            ring = joined.sort_values(["ts", "tie"], kind="stable").tail(self.window)
        x = ring[self.sensors].to_numpy(float)
        known = ~np.isnan(x)
        self.ring.update((
            [int(v) for v in ring["ts"]], [int(v) for v in ring["tie"]],
            *[[float(v) if ok else None for v, ok in zip(x[:, i], known[:, i])] for i in range(len(self.sensors))],
        ))
        # A ring is a few dozen rows: moments are taken anew, without the drift that adding and taking away would bring.
        n = known.sum(axis=0)
        mean = np.where(known, x, 0).sum(axis=0) / np.maximum(n, 1)
        spread = np.sqrt((np.where(known, x - mean, 0) ** 2).sum(axis=0) / np.maximum(n - 1, 1))
        trend = x[-1] - x[-2] if len(x) > 1 else np.zeros(len(self.sensors))
        row = {"machine_id": key[0], "last_ts": pd.to_datetime(int(ring["ts"].iloc[-1]), unit="us")}
        for i, c in enumerate(self.sensors):
            for kind, value in zip(_KINDS, (x[-1, i], mean[i], spread[i] if n[i] > 1 else 0.0, trend[i])):
                row[f"{c}{kind}"] = 0.0 if np.isnan(value) else float(value)
        yield pd.DataFrame([row])

    def close(self) -> None:
        pass


def live_features_stream(rows: DataFrame, sensors: list[str], window: int = ROLLING_WINDOW, keys: Keys = Keys()) -> DataFrame:
    """Streaming form of ``newest_features``: a row per asset and batch that brings readings of it (RocksDB state store)."""
    ready = rows.select(
        F.col(keys.id).alias("machine_id"), F.col(keys.ts).cast("timestamp").alias("timestamp"), F.col(keys.tie).cast("long").alias("tie"),
        *[F.col(c).cast("double").alias(c) for c in sensors],
    )
    trimmed = ready.mapInPandas(_trimmed(window), ready.schema)
    out = "machine_id string, last_ts timestamp, " + ", ".join(f"{c}{kind} double" for c in sensors for kind in _KINDS)
    return trimmed.groupBy("machine_id").transformWithStateInPandas(RingProcessor(sensors, window), out, "update", "none")


def live_life_stream(rows: DataFrame, model: RulModel, window: int = ROLLING_WINDOW, keys: Keys = Keys(), forest: FlatForest | None = None) -> DataFrame:
    """Streaming form of ``live_life``: newest remaining life of each asset that got readings."""
    forest = forest or flatten(rows.sparkSession, model.model)
    features = live_features_stream(rows, _model_sensors(model), window, keys)
    return predicted(features, forest, model.features, Keys("machine_id", keys.ts, keys.tie))
