"""Source-side slices: each preset is a filter that Spark pushes into the scan."""

from __future__ import annotations

from datetime import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.columns import Keys


class Preset(NamedTuple):
    label: str
    domains: tuple | None
    params: dict


# Preset names, domains and default parameters.
PRESETS = {
    "last_n_rows": Preset("Last N rows", None, {"n": None}),
    "last_n_days": Preset(
        "Last N days", ("predictive_maintenance", "plant_oee", "energy_utilities"),
        {"n": 30, "ts_col": "timestamp", "limit": None},
    ),
    "filter_machine_id": Preset(
        "Filter by machine_id", ("predictive_maintenance", "plant_oee"), {"machine_id": "M-001", "n": 0}
    ),
    "filter_asset_id": Preset(
        "Filter by asset_id", ("predictive_maintenance", "plant_oee"), {"asset_id": "ASSET-001", "n": 0}
    ),
    "date_range": Preset(
        "Date range window", None,
        {"start_date": "2024-01-01", "end_date": "2024-06-01", "ts_col": "timestamp", "n": 0},
    ),
    "sample_percent": Preset("Random sample %", None, {"sample_pct": 5.0}),
    "pdm_failure_focus": Preset(
        "PdM — failures + near-failure window", ("predictive_maintenance",), {"rul_max": 48, "limit": None}
    ),
}


def list_presets(domain: str | None = None) -> list[str]:
    return [k for k, p in PRESETS.items() if not domain or p.domains is None or domain in p.domains]


def _time(df: DataFrame, column: str) -> Column:
    """Typed time columns stay bare, so the filter reaches the file scan."""
    text = isinstance(df.schema[column].dataType, T.StringType)
    return F.expr(f"try_cast(`{column}` AS TIMESTAMP)") if text else F.col(column)


def last_n_rows(df: DataFrame, n: int, keys: Keys = Keys(), mode: str = "newest") -> DataFrame:
    """Newest ``n`` rows (top-k, no full sort); ``mode="any"`` is a plain limit."""
    if mode == "any":
        return df.limit(n)
    return df.orderBy(_time(df, keys.ts).desc_nulls_last(), F.col(keys.tie).desc()).limit(n)


def last_n_days(
    df: DataFrame, n: int, as_of: datetime | Column, ts_col: str = "timestamp", tie: str = "event_id",
    limit: int | None = None,
) -> DataFrame:
    """Rows from ``as_of - n days`` on.  Ordered newest first only when a limit is asked for."""
    bound = (as_of if isinstance(as_of, Column) else F.lit(as_of)) - F.make_dt_interval(F.lit(int(n)))
    ts = _time(df, ts_col)
    kept = df.filter(ts >= bound)
    return kept.orderBy(ts.desc(), F.col(tie).desc()).limit(limit) if limit else kept


def filter_asset(df: DataFrame, value: str, key: str = "machine_id", n: int = 0, keys: Keys = Keys()) -> DataFrame:
    """One asset; the value is a literal, never spliced text."""
    kept = df.filter(F.col(key) == F.lit(value))
    if not n:
        return kept
    return kept.orderBy(_time(df, keys.ts).desc_nulls_last(), F.col(keys.tie).desc()).limit(n)


def date_range(
    df: DataFrame, start: str, end: str, ts_col: str = "timestamp", n: int = 0, tie: str = "event_id"
) -> DataFrame:
    """``start`` inclusive, ``end`` exclusive."""
    ts = _time(df, ts_col)
    kept = df.filter((ts >= F.lit(start).cast("timestamp")) & (ts < F.lit(end).cast("timestamp")))
    return kept.orderBy(ts, tie).limit(n) if n else kept


def sample_percent(df: DataFrame, pct: float, key: str | None = None, seed: int = 42) -> DataFrame:
    """Random share of rows; with ``key`` the same rows are drawn on every run and partitioning."""
    if key is None:
        return df.sample(fraction=pct / 100.0, seed=seed)
    # md5 of "seed:key" is the same number in any engine; 13 hexadecimal digits fit a long.
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    return df.filter(F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") % 10_000 < int(pct * 100))


def failure_focus(
    df: DataFrame, rul_max: float = 48, failure: str = "failure", rul: str = "rul", keys: Keys = Keys(),
    limit: int | None = None,
) -> DataFrame:
    """Failed rows and rows close to failure."""
    failed = F.coalesce(F.expr(f"try_cast(`{failure}` AS INT)"), F.lit(0)) == 1
    near = F.coalesce(F.expr(f"try_cast(`{rul}` AS DOUBLE)") <= rul_max, F.lit(False))
    kept = df.filter(failed | near)
    if limit is None:
        return kept
    return kept.orderBy(_time(df, keys.ts).desc_nulls_last(), F.col(keys.tie).desc()).limit(limit)


def page(df: DataFrame, offset: int, n: int, keys: Keys = Keys()) -> DataFrame:
    """Rows ``offset .. offset + n`` in (ts, tie) order."""
    return df.orderBy(*keys.order).offset(offset).limit(n)


def slice_table(df: DataFrame, preset: str, as_of: datetime | None = None, keys: Keys = Keys(), **params) -> DataFrame:
    """Dispatch by preset name; nothing is cut off unless the caller gives a number of rows."""
    if preset not in PRESETS:
        raise ValueError(f"unknown preset {preset!r}")
    p = dict(PRESETS[preset].params) | params
    unknown = set(params) - set(PRESETS[preset].params)
    if unknown:
        raise ValueError(f"unknown parameters for {preset}: {sorted(unknown)}")
    if preset == "last_n_rows":
        if not p["n"]:
            raise ValueError("last_n_rows needs n")
        return last_n_rows(df, int(p["n"]), keys)
    if preset == "last_n_days":
        if as_of is None:
            raise ValueError("last_n_days needs as_of")
        return last_n_days(df, int(p["n"]), as_of, p["ts_col"], keys.tie, limit=p["limit"])
    if preset == "filter_machine_id":
        return filter_asset(df, str(p["machine_id"]), "machine_id", int(p["n"]), keys)
    if preset == "filter_asset_id":
        return filter_asset(df, str(p["asset_id"]), "asset_id", int(p["n"]), keys)
    if preset == "date_range":
        return date_range(df, str(p["start_date"]), str(p["end_date"]), p["ts_col"], int(p["n"]), keys.tie)
    if preset == "sample_percent":
        return sample_percent(df, float(p["sample_pct"]))
    return failure_focus(df, float(p["rul_max"]), keys=keys, limit=p["limit"])
