"""The batch reliability pipeline, step by step, as one call."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from ..constants import ANOMALY_CONTAMINATION
from ..functions.columns import Keys
from ..operators import advisory, clean, driver, fleet, iforest, insights, mapping, physics, quality, rul
from ..operators.series import SeriesProfile, profile_series
from ..session import kept
from ..streaming.payload import flight_log


class Bundle(NamedTuple):
    """Results of the physics-and-advice layer over one table."""

    annotated: DataFrame
    physics: DataFrame
    drivers: DataFrame
    items: DataFrame
    focus: DataFrame


def clean_and_quality(
    df: DataFrame, keys: Keys = Keys(), profile: SeriesProfile | None = None, run_quality: bool = True,
    checks: list[str] | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """Cleaned table, written once for the many passes of the report, and the report.

    ``checks`` names stages that are plain statistics; the report then has only these, from two passes.
    """
    cleaned = kept(clean.clean_sensor_data(df, keys, profile), "cleaned")
    if not run_quality:
        return cleaned, None
    report = quality.run_stages(cleaned, checks, keys) if checks else quality.quality_report(cleaned, keys)
    return cleaned, report


def advice_bundle(
    df: DataFrame, predictions: DataFrame, health: DataFrame, pack_id: str | None = None,
    chosen: str | None = None, keys: Keys = Keys(),
) -> Bundle:
    """Red-lines, drivers and one advisory per asset over one table."""
    annotated = physics.apply_physics_rules(df, pack_id)
    summary = physics.summarize_physics(annotated, pack_id, keys)
    drivers = driver.sensor_drivers(annotated, predictions, keys=keys)
    items = advisory.advisory_items(predictions, summary, health, drivers, df, keys)
    return Bundle(annotated, summary, drivers, items, fleet.worst_asset(health, chosen, keys))


def hand_off(log: DataFrame, pack_id: str | None = None, keys: Keys = Keys()) -> DataFrame:
    """The stream's log as a batch table: raw payload dropped, headers mapped, cleaned; ready for ``run_reliability``."""
    mapped = mapping.apply_mapping(flight_log(log), mapping.suggest_mapping(log.columns, pack_id))
    mapping.require_detectable(mapped)
    if keys.tie not in mapped.columns:
        # The log has no row number: the whole row's hash orders rows of one time.
        mapped = mapped.withColumn(keys.tie, F.xxhash64(*mapped.columns))
    return clean.clean_sensor_data(mapped, keys)


class Reliability(NamedTuple):
    scored: DataFrame
    forest: iforest.ForestModel
    rul_model: rul.RulModel
    predictions: DataFrame
    health: DataFrame
    kpis: DataFrame
    bundle: Bundle
    assets: DataFrame
    brief: DataFrame


def run_reliability(
    df: DataFrame,
    pack_id: str | None = None,
    keys: Keys = Keys(),
    contamination: float = ANOMALY_CONTAMINATION,
    trees: int = 100,
    rul_trees: int = 100,
    per_hour: float = 0.0,
    per_unit: float = 0.0,
) -> Reliability:
    """Map, clean, red-lines, anomaly scores, remaining life, health, advice, brief.

    The cleaned table and the predictions are written to the shared folder because several branches read each (as the
    scores are by the forest): nothing is held in memory afterwards, and a lost executor takes no result with it.
    """
    mapped = mapping.apply_mapping(df, mapping.suggest_mapping(df.columns, pack_id))
    mapping.require_detectable(mapped)
    profile = profile_series(mapped, keys)
    cleaned = kept(clean.clean_sensor_data(mapped, keys, profile), "cleaned")
    annotated = physics.apply_physics_rules(cleaned, pack_id)
    forest, scored = iforest.fit_annotate(annotated, contamination=contamination, trees=trees, keys=keys)
    featured = rul.rul_features(scored, keys, profile=profile)
    model = rul.fit_rul(featured, keys, trees=rul_trees)
    predictions = kept(rul.predict_latest(model, featured, keys), "predictions")
    health = fleet.asset_health(scored, predictions, pack_id, keys)
    kpis = fleet.pack_kpis(scored, predictions, pack_id, keys, health, profile.rows)
    bundle = advice_bundle(scored, predictions, health, pack_id, keys=keys)
    assets = advisory.asset_table(scored, predictions, health, bundle.items, bundle.physics, pack_id, keys)
    brief = insights.industrial_brief(scored, predictions, per_hour, per_unit, keys=keys, rows=profile.rows)
    return Reliability(scored, forest, model, predictions, health, kpis, bundle, assets, brief)
