"""Per-asset joins: advisory, asset table with work orders, fleet strip, health events."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from ..constants import ALL_SENSORS, FAULT_NONE, HEALTH_EVENT_KEYS, HEALTH_EVENT_SCHEMA, pack
from ..functions.columns import Keys, as_double
from ..functions.scalars import (
    advisory_action,
    go_nogo,
    iso_utc,
    mission_line,
    mission_success,
    normalize_risk,
    twin_region,
    work_order_id,
)
from .joins import merge_by_asset


def advisory_items(
    predictions: DataFrame,
    physics: DataFrame,
    health: DataFrame,
    drivers: DataFrame | None = None,
    readings: DataFrame | None = None,
    keys: Keys = Keys(),
) -> DataFrame:
    """One row per asset of the id union over all inputs."""
    slots = {
        "p": predictions.select(keys.id, "risk_level"),
        "f": physics.select(keys.id, "physics_fault", "physics_rule", "physics_label", "region"),
        "h": health.select(keys.id, "risk_level", "health_index"),
    }
    if drivers is not None:
        slots["d"] = drivers.select(keys.id, "sensor", "region", "region_label")
    if readings is not None:
        slots["r"] = readings.select(keys.id, F.lit(True).alias("seen"))
    out = merge_by_asset(slots, keys=keys)
    text = F.lit(None).cast("string")
    sensor, region, phrase = (
        (F.col("d.sensor"), F.col("d.region"), F.col("d.region_label")) if drivers is not None else (text, text, text)
    )
    out = out.select(
        keys.id,
        F.coalesce(F.nullif(F.col("p.risk_level"), F.lit("")), F.col("h.risk_level")).alias("risk"),
        F.coalesce("f.physics_fault", F.lit(FAULT_NONE)).alias("physics_fault"),
        F.coalesce("f.physics_rule", F.lit("")).alias("physics_rule"),
        F.coalesce("f.physics_label", F.lit(FAULT_NONE)).alias("physics_label"),
        sensor.alias("sensor"), F.coalesce(F.nullif(region, F.lit("")), F.col("f.region")).alias("region"),
        phrase.alias("phrase"), F.col("h.health_index").alias("health_index"),
    )
    hi = F.col("health_index")
    return out.select(
        keys.id,
        advisory_action(F.col("risk"), F.col("physics_fault"), F.col("sensor"), F.col("region"), F.col("phrase")).alias("action"),
        "physics_fault", "physics_rule", "physics_label",
        normalize_risk(F.col("risk")).alias("risk_level"),
        hi,
        F.when(hi.isNotNull(), mission_success(hi)).alias("mission_success_pct"),
        F.when(hi.isNotNull(), mission_line(F.col(keys.id), hi)).otherwise("").alias("mission_line"),
    )


def advisory_text(items: DataFrame, keys: Keys = Keys()) -> DataFrame:
    """``A: Inspect oil · B: OK`` sorted by asset, for a chosen slice of the fleet.

    The caller picks the slice: the text is one row and grows with it.
    """
    pair = F.struct(F.col(keys.id).alias("i"), F.concat_ws(": ", keys.id, "action").alias("t"))
    listed = F.transform(F.sort_array(F.collect_list(pair)), lambda s: s["t"])
    return items.agg(F.array_join(listed, " · ").alias("advisory"))


def asset_table(
    readings: DataFrame,
    predictions: DataFrame,
    health: DataFrame,
    items: DataFrame,
    physics: DataFrame,
    pack_id: str | None = None,
    keys: Keys = Keys(),
) -> DataFrame:
    """One row per asset with advisory, decision and open work-order stub."""
    p = pack(pack_id)
    out = merge_by_asset(
        {
            "p": predictions.select(keys.id, "risk_level"),
            "h": health.select(keys.id, "risk_level", "health_index", "mission_success_pct"),
            "i": items.select(keys.id, "action"),
            "f": physics.select(keys.id, "physics_fault"),
        },
        {"r": readings.select(keys.id, keys.ts, keys.tie)},
        keys,
    )
    risk = normalize_risk(F.coalesce(F.nullif(F.col("p.risk_level"), F.lit("")), F.col("h.risk_level")))
    out = out.withColumns({"risk_level": risk, "physics_fault": F.coalesce("f.physics_fault", F.lit(FAULT_NONE))})
    action = F.coalesce(F.nullif(F.col("i.action"), F.lit("")), advisory_action(F.col("risk_level"), F.col("physics_fault")))
    out = out.withColumn("advisory", action)
    out = out.withColumn("work_order_id", work_order_id(F.col(keys.id), F.col("advisory")))
    hi, order = F.col("h.health_index"), F.col("work_order_id")
    return out.select(
        keys.id,
        F.lit(p.id).alias("pack_id"),
        F.lit(p.short).alias("pack"),
        F.coalesce(F.date_format(F.col("r")[keys.ts], "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("")).alias("last_timestamp"),
        "risk_level",
        hi.alias("health_index"),
        F.coalesce(F.col("h.mission_success_pct"), F.when(hi.isNotNull(), mission_success(hi))).alias("mission_success_pct"),
        "advisory",
        go_nogo(F.col("advisory"), F.col("risk_level")).alias("go_nogo"),
        order,
        F.when(order != "", F.col("advisory")).otherwise("").alias("wo_title"),
        F.when(order != "", "open").otherwise("").alias("wo_status"),
        "physics_fault",
    )


def decision_order(keys: Keys = Keys()):
    """NO-GO first, then CAUTION, then GO; health as a number; id."""
    rank = F.when(F.col("go_nogo") == "NO-GO", 0).when(F.col("go_nogo") == "CAUTION", 1).otherwise(2)
    return [rank, F.col("health_index").asc_nulls_last(), F.col(keys.id)]


def fleet_strip(items: DataFrame, health: DataFrame, keys: Keys = Keys()) -> DataFrame:
    """Compact status strip: tail, success chance, advisory, decision."""
    h = health.select(
        keys.id, F.col("health_index").alias("__hi"), F.col("mission_success_pct").alias("__pct"), F.col("risk_level").alias("__risk")
    )
    out = items.join(h, keys.id, "left")
    risk = F.coalesce("risk_level", "__risk", F.lit(""))
    return out.select(
        F.col(keys.id).alias("tail"),
        F.coalesce("mission_success_pct", "__pct").alias("mission_pct"),
        F.col("action").alias("advisory"),
        go_nogo(F.col("action"), risk).alias("go_nogo"),
        risk.alias("risk"),
        F.coalesce("health_index", "__hi").alias("health"),
    )


def health_events(
    readings: DataFrame,
    predictions: DataFrame,
    physics: DataFrame,
    items: DataFrame,
    health: DataFrame,
    drivers: DataFrame | None = None,
    pack_id: str | None = None,
    as_of: datetime | None = None,
    keys: Keys = Keys(),
) -> DataFrame:
    """Nested record per asset: newest sensors, physics, model verdicts, advisory, region.

    An asset without readings takes ``as_of`` as its time.
    """
    p = pack(pack_id)
    sensors = [c for c in ALL_SENSORS if c in readings.columns]
    extra = [c for c in ("anomaly_score", "is_anomaly") if c in readings.columns]
    rounded = [F.bround(as_double(readings, c), 4).alias(c) for c in sensors]
    slots = {
        "p": predictions.select(keys.id, "predicted_rul_days", "risk_level", "is_proxy", "label_source"),
        "f": physics.select(keys.id, "physics_alert", "physics_fault", "physics_rule", "physics_label"),
        "i": items.select(keys.id, "action"),
        "h": health.select(keys.id, "health_index", "mission_success_pct"),
    }
    if drivers is not None:
        slots["d"] = drivers.select(keys.id, "sensor", "region")
    out = merge_by_asset(slots, {"r": readings.select(keys.id, keys.ts, keys.tie, *rounded, *extra)}, keys)
    text = F.lit(None).cast("string")
    region, sensor = (F.col("d.region"), F.col("d.sensor")) if drivers is not None else (text, text)
    cells = [F.struct(F.lit(c).alias("key"), F.col("r")[c].alias("value")) for c in sensors]
    values = (
        F.map_from_entries(F.filter(F.array(*cells), lambda e: e["value"].isNotNull()))
        if cells else F.create_map().cast("map<string,double>")
    )
    fault = F.coalesce("f.physics_fault", F.lit(FAULT_NONE))
    action = F.coalesce("i.action", F.lit(""))
    none_double, none_bool = F.lit(None).cast("double"), F.lit(None).cast("boolean")
    out = out.select(
        F.lit(HEALTH_EVENT_SCHEMA).alias("schema"),
        F.col(keys.id).alias("asset"),
        iso_utc(F.coalesce(F.col("r")[keys.ts].cast("timestamp"), F.lit(as_of).cast("timestamp"))).alias("time"),
        F.lit(p.id).alias("pack_id"),
        F.lit(p.short).alias("pack"),
        values.alias("sensors"),
        F.struct(
            F.coalesce("f.physics_alert", F.lit(False)).alias("alert"), fault.alias("fault"),
            F.coalesce("f.physics_rule", F.lit("")).alias("rule"), F.coalesce("f.physics_label", F.lit(FAULT_NONE)).alias("label"),
        ).alias("physics"),
        F.struct(
            (F.bround(F.col("r.anomaly_score"), 4) if "anomaly_score" in extra else none_double).alias("anomaly_score"),
            (F.col("r.is_anomaly") if "is_anomaly" in extra else none_bool).alias("is_anomaly"),
        ).alias("iforest"),
        F.struct(
            F.col("p.predicted_rul_days").alias("predicted_rul_days"), F.coalesce("p.risk_level", F.lit("")).alias("risk_level"),
            F.coalesce("p.is_proxy", F.lit(False)).alias("is_proxy"), F.coalesce("p.label_source", F.lit("")).alias("label_source"),
        ).alias("rul"),
        F.coalesce("p.risk_level", F.lit("")).alias("risk_level"),
        action.alias("advisory"),
        twin_region(fault, region, sensor).alias("twin_region"),
        F.col("h.health_index").alias("health_index"),
        F.col("h.mission_success_pct").alias("mission_success_pct"),
        work_order_id(F.col(keys.id), action).alias("work_order_id"),
    )
    missing = missing_event_keys(out)
    if missing:
        raise ValueError(f"health events miss required keys: {missing}")
    return out


def missing_event_keys(events: DataFrame) -> list[str]:
    return [k for k in HEALTH_EVENT_KEYS if k not in events.columns]
