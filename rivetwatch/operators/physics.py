"""Red-line rules: deterministic limits per industry pack, before any model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import (
    FAULT_LOW_OIL,
    FAULT_NONE,
    FAULT_OVERHEATING,
    FAULT_VIBRATION,
    LIMITS_AVIATION,
    LIMITS_DEFAULT,
    PHYSICS_COLUMNS,
    RED_LINES,
)
from ..functions.columns import Keys, as_double, find_col
from ..functions.scalars import ata_label, fault_region, is_valid_asset


def limits_for(pack_id: str | None) -> dict[str, float]:
    return LIMITS_AVIATION if pack_id == "aviation_uav_piston" else LIMITS_DEFAULT


def active_red_lines(df: DataFrame, pack_id: str | None = None):
    """(red-line, column) pairs this table supports; the temperature rule yields to a CHT column."""
    found = []
    lower = {c.lower(): c for c in df.columns}
    for line in RED_LINES:
        if line.key == "temp" and any(hit.key == "cht" for hit, _ in found):
            continue
        column = next((lower[n] for n in line.names if n in lower), None)
        if column is None and line.loose:
            column = find_col(df.columns, *line.names)
        if column is not None:
            found.append((line, column))
    return found


def apply_physics_rules(df: DataFrame, pack_id: str | None = None) -> DataFrame:
    """Add the four physics columns.  Pure column work: batch and stream alike."""
    limits = limits_for(pack_id)
    base = df.drop(*PHYSICS_COLUMNS)
    hits: list[tuple] = []
    for line, column in active_red_lines(base, pack_id):
        value, limit = as_double(base, column), F.lit(limits[line.key])
        hits.append((line, F.coalesce(value > limit if line.above else value < limit, F.lit(False))))

    def listed(text) -> Column:
        return F.concat_ws("; ", *[F.when(hit, F.lit(text(line))) for line, hit in hits]) if hits else F.lit("")

    def any_of(fault: str) -> Column:
        out = F.lit(False)
        for line, hit in hits:
            if line.fault == fault:
                out = out | hit
        return out

    fault = (
        F.when(any_of(FAULT_LOW_OIL), FAULT_LOW_OIL)
        .when(any_of(FAULT_OVERHEATING), FAULT_OVERHEATING)
        .when(any_of(FAULT_VIBRATION), FAULT_VIBRATION)
        .otherwise(FAULT_NONE)
    )
    labels = listed(lambda line: line.label)
    return base.withColumns(
        {
            "physics_alert": fault != FAULT_NONE,
            "physics_fault": fault,
            "physics_rule": listed(lambda line: line.rule),
            "physics_label": F.when(labels == "", FAULT_NONE).otherwise(labels),
        }
    )


def summarize_physics(df: DataFrame, pack_id: str | None = None, keys: Keys = Keys()) -> DataFrame:
    """Per asset: verdict of the newest row and the number of alert rows ever.

    One partial aggregation; a huge asset costs each task one small buffer.
    """
    rows = df if "physics_fault" in df.columns else apply_physics_rules(df, pack_id)
    newest = F.max_by(F.struct(*PHYSICS_COLUMNS), keys.stamp()).alias("r")
    return (
        rows.filter(is_valid_asset(F.col(keys.id)))
        .groupBy(F.trim(F.col(keys.id).cast("string")).alias(keys.id))
        .agg(newest, F.count_if("physics_alert").alias("n_alert_rows"))
        .select(keys.id, "r.*", "n_alert_rows", fault_region(F.col("r.physics_fault")).alias("region"))
    )


def physics_table(summary: DataFrame, keys: Keys = Keys()) -> DataFrame:
    """Display table: asset, rule fired, human label, chapter."""
    rule = F.col("physics_rule")
    return summary.select(
        F.col(keys.id).alias("asset"),
        F.when(rule == "", "—").otherwise(rule).alias("rule_fired"),
        F.col("physics_label").alias("human_label"),
        ata_label(F.col("physics_fault"), rule).alias("ata_100"),
    )
