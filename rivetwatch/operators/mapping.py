"""Header mapping and pack detection: decisions on names, never on whole columns of data."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..constants import (
    CANONICAL_FIELDS,
    CORE_SENSORS,
    DEFAULT_PACK,
    HEADER_ALIASES,
    OPTIONAL_SENSORS,
    PACKS,
    pack,
)
from ..functions.columns import Keys, norm_header, numeric_columns


def suggest_mapping(columns: list[str], pack_id: str | None = None, extra_aliases: dict | None = None) -> dict:
    """Canonical field -> source header (or None).  Core fields choose before pack extras."""
    extras = extra_aliases if extra_aliases is not None else (pack(pack_id).extra_aliases if pack_id else {})
    wanted = dict(HEADER_ALIASES) | {k: v for k, v in extras.items() if k not in HEADER_ALIASES}
    by_norm = {norm_header(c): c for c in columns}
    free = list(columns)
    mapping: dict[str, str | None] = {}
    for field, aliases in wanted.items():
        hit = next(filter(None, (_match(norm_header(a), by_norm, free) for a in aliases)), None)
        mapping[field] = hit
        free = [c for c in free if c != hit]
    return mapping


def _match(alias: str, by_norm: dict, free: list[str]) -> str | None:
    if by_norm.get(alias) in free:
        return by_norm[alias]
    return next((c for c in free if alias and alias in norm_header(c)), None)


def apply_mapping(df: DataFrame, mapping: dict) -> DataFrame:
    """Rename sources to canonical names; a target that already exists is left alone."""
    renames = {
        source: field
        for field, source in mapping.items()
        if source and source in df.columns and source != field and field not in df.columns
    }
    return df.withColumnsRenamed(renames)


def mapping_status(df: DataFrame) -> dict:
    sensors = [c for c in CORE_SENSORS if c in df.columns]
    return {
        "present": [c for c in CANONICAL_FIELDS if c in df.columns],
        "sensors": sensors,
        "has_timestamp": "timestamp" in df.columns,
        "has_machine": "machine_id" in df.columns,
        "has_rul_label": "failure_within_days" in df.columns,
        "sensor_count": len(sensors),
    }


def can_detect(df: DataFrame) -> bool:
    """Detection needs at least one mapped core sensor."""
    return mapping_status(df)["sensor_count"] > 0


def require_detectable(df: DataFrame) -> None:
    if not can_detect(df):
        raise ValueError("map at least one of " + ", ".join(CORE_SENSORS) + " before detecting anomalies")


def pack_scores(df: DataFrame, filename: str = "", keys: Keys = Keys()) -> DataFrame:
    """Score of every pack as rows ``(pack_id, score, position)``.

    Headers and file name are judged on the driver.  Asset ids never leave the
    executors: each keyword and prefix is one boolean aggregate.
    """
    header_blob = " ".join([*df.columns, filename]).lower().replace("_", " ")
    lower_names = {c.lower() for c in df.columns}
    has_ids = keys.id in df.columns
    raw = F.col(keys.id).cast("string") if has_ids else F.lit("")
    spaced = F.translate(F.lower(raw), "_", " ")

    rows = []
    for position, p in enumerate(PACKS.values()):
        score = F.lit(3.0 * sum(c.lower() in lower_names for c in p.columns))
        for word in p.keywords:
            hit = F.lit(word in header_blob)
            if has_ids:
                hit = hit | F.coalesce(F.bool_or(spaced.contains(word)), F.lit(False))
            score = score + F.when(hit, 1.5).otherwise(0.0)
        if has_ids:
            any_prefix = [raw.startswith(x) | F.lower(raw).contains(x.lower()) for x in p.id_prefixes]
            seen = any_prefix[0]
            for more in any_prefix[1:]:
                seen = seen | more
            score = score + F.when(F.coalesce(F.bool_or(seen), F.lit(False)), 2.0).otherwise(0.0)
        named = F.lit(p.demo_name in header_blob)
        score = score + F.when(named, 2.0).otherwise(0.0)
        rows.append(F.struct(F.lit(p.id).alias("pack_id"), score.alias("score"), F.lit(position).alias("position")))
    return df.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def suggest_pack(df: DataFrame, filename: str = "", keys: Keys = Keys()) -> str:
    """Best pack; the first listed wins ties, and no evidence means the plant pack."""
    best = pack_scores(df, filename, keys).orderBy(F.col("score").desc(), "position").first()
    return best["pack_id"] if best["score"] > 0 else DEFAULT_PACK


def preferred_metric(df: DataFrame, pack_id: str | None = None) -> str | None:
    """First pack chart metric present as a numeric column."""
    numeric = {c.lower(): c for c in numeric_columns(df)}
    return next((numeric[m] for m in pack(pack_id).charts if m in numeric), None)


def live_chart_metrics(columns: list[str], pack_id: str | None = None) -> list[str]:
    """Live metrics that are present, preferred ones first."""
    preferred = ("cht", "egt", "oil_pressure", "vibration", "rpm", "temperature", "pressure", "fuel_flow", "oil_temp")
    if pack_id != "aviation_uav_piston":
        preferred = CORE_SENSORS + preferred
    ordered = [c for c in (*preferred, *OPTIONAL_SENSORS) if c in columns]
    return list(dict.fromkeys(ordered))
