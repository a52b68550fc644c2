"""Sinks: tables, health-event documents and asset rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from ..constants import HEALTH_EVENT_SCHEMA, pack
from ..functions.columns import Keys


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Parquet or CSV; partition by a bounded column such as a date or an asset bucket."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path)


def with_storage_keys(df: DataFrame, buckets: int = 64, keys: Keys = Keys()) -> DataFrame:
    """Partition columns for storage: reading date and a bounded asset bucket."""
    return df.withColumns(
        {"reading_date": F.to_date(keys.ts), "asset_bucket": F.pmod(F.xxhash64(keys.id), F.lit(buckets)).cast("int")}
    )


def health_event_head(events: DataFrame, pack_id: str | None, generated_at: datetime) -> DataFrame:
    """Document head: schema, pack, time and event count."""
    at = F.date_format(F.lit(generated_at).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return events.agg(F.count(F.lit(1)).alias("count")).select(
        F.lit(HEALTH_EVENT_SCHEMA).alias("schema"), F.lit(pack(pack_id).id).alias("pack_id"),
        at.alias("generated_at"), "count",
    )


def write_health_events(events: DataFrame, path: str, pack_id: str | None, generated_at: datetime, mode: str = "errorifexists") -> None:
    """One JSON event per line under ``events``; the head is one line under ``document``."""
    events.write.mode(mode).json(f"{path}/events")
    health_event_head(events, pack_id, generated_at).write.mode(mode).json(f"{path}/document")


def write_assets(assets: DataFrame, path: str, version: int = 1, mode: str = "errorifexists") -> None:
    assets.withColumn("version", F.lit(version)).write.mode(mode).json(path)
