"""The query behind each chart; drawing is left to the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..constants import ROLLING_WINDOW
from ..functions.columns import Keys
from .joins import filter_assets
from .rul import label_predictions
from .series import SeriesProfile, add_windowed, rolling_mean


def sensor_over_time(df: DataFrame, metric: str, assets=None, keys: Keys = Keys(), every: str | None = None) -> DataFrame:
    """Readings of one metric; ``every`` averages them per time window first."""
    rows = filter_assets(df, assets, keys).select(keys.id, keys.ts, metric)
    if not every:
        return rows
    return rows.groupBy(keys.id, F.window(keys.ts, every).alias("w")).agg(F.avg(metric).alias(metric)).select(
        keys.id, F.col("w.start").alias(keys.ts), metric
    )


def anomaly_timeline(scored: DataFrame, metric: str, assets=None, keys: Keys = Keys()) -> DataFrame:
    """Flagged readings only."""
    rows = filter_assets(scored, assets, keys).filter("is_anomaly")
    return rows.select(keys.id, keys.ts, keys.tie, metric, "anomaly_score")


def anomaly_scatter(scored: DataFrame, x: str, y: str, assets=None, keys: Keys = Keys()) -> DataFrame:
    kind = F.when(F.col("is_anomaly"), "Anomaly").otherwise("Normal").alias("anomaly")
    return filter_assets(scored, assets, keys).select(keys.id, keys.tie, x, y, kind)


def risk_by_asset(df: DataFrame, predictions: DataFrame | None = None, assets=None, keys: Keys = Keys()) -> DataFrame:
    """Predicted life and risk per asset, from the newest label when nothing is predicted."""
    rows = predictions if predictions is not None else label_predictions(df, keys)
    return filter_assets(rows, assets, keys).select(keys.id, "predicted_rul_days", "risk_level")


def rolling_trend(
    df: DataFrame, metric: str, window: int = ROLLING_WINDOW, assets=None, keys: Keys = Keys(),
    profile: SeriesProfile | None = None,
) -> DataFrame:
    rows = filter_assets(df, assets, keys).select(keys.id, keys.ts, keys.tie, metric)
    return add_windowed(rows, {"rolling": rolling_mean(metric, window)}, window - 1, keys, profile)


def health_by_asset(health: DataFrame, keys: Keys = Keys()) -> DataFrame:
    return health.select(keys.id, "health_index", "risk_level")


def kpi_bars(kpis: DataFrame) -> DataFrame:
    """Numeric KPIs only."""
    return kpis.filter(F.col("value").isNotNull()).select("label", "value", "severity")
