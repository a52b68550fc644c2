"""Column lookup and type helpers that work on schemas only (no jobs)."""

from __future__ import annotations

import re
from typing import Iterable, NamedTuple

from pyspark.sql import DataFrame, functions as F, types as T

from ..constants import (
    ALL_SENSORS,
    CANONICAL_FIELDS,
    DERIVED_SUFFIXES,
    OTHER_REGION,
    SENSOR_REGIONS,
    SENSOR_SHORT_NAMES,
    VERDICT_COLUMNS,
)


class Keys(NamedTuple):
    """The three columns that give a reading its identity and its order.

    ``tie`` breaks equal timestamps so every ordered result is deterministic.
    """

    id: str = "machine_id"
    ts: str = "timestamp"
    tie: str = "event_id"

    @property
    def order(self) -> list[str]:
        return [self.ts, self.tie]

    def stamp(self):
        """Orderable struct of (ts, tie), for ``max_by`` and friends."""
        return F.struct(F.col(self.ts), F.col(self.tie))


def find_col(columns: Iterable[str], *names: str, skip: Iterable[str] = ()) -> str | None:
    """Exact case-insensitive name first, then substring, in argument order.

    Substring hits never land on a canonical or verdict column by accident:
    ``failure`` must not resolve to ``failure_within_days``.
    """
    by_lower = {c.lower(): c for c in columns}
    for name in names:
        if name.lower() in by_lower:
            return by_lower[name.lower()]
    barred = set(skip) | VERDICT_COLUMNS | set(CANONICAL_FIELDS)
    for name in names:
        for lower, real in by_lower.items():
            if name.lower() in lower and real not in barred:
                return real
    return None


def norm_header(name: str) -> str:
    """Lower-case, every non-alphanumeric character to ``_``, outer ``_`` stripped."""
    return re.sub(r"[\W_]", "_", str(name).lower()).strip("_")


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    gone = set(exclude)
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in gone
    ]


def string_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    gone = set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in gone]


def sensor_columns(df: DataFrame, keys: Keys = Keys(), verdicts: Iterable[str] = VERDICT_COLUMNS) -> list[str]:
    """Numeric measurement columns: no keys, no verdicts, no derived columns."""
    gone = set(verdicts) | {keys.id, keys.ts, keys.tie}
    return [c for c in numeric_columns(df, gone) if not c.endswith(DERIVED_SUFFIXES)]


def model_features(df: DataFrame, keys: Keys = Keys()) -> list[str]:
    """Known sensors in their fixed order; any other numeric sensor only when none is known."""
    known = [c for c in ALL_SENSORS if c in df.columns]
    return known or sensor_columns(df, keys)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every floating column, so comparisons skip it."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    if not floats:
        return df
    return df.withColumns({c: F.when(~F.isnan(F.col(c)), F.col(c)) for c in floats})


def as_double(df: DataFrame, column: str):
    """Column as DOUBLE; text that is not a number becomes NULL, and so does NaN."""
    c = F.col(column)
    if isinstance(df.schema[column].dataType, T.StringType):
        c = F.expr(f"try_cast(`{column}` AS DOUBLE)")
    else:
        c = c.cast("double")
    return F.when(~F.isnan(c), c)


def _squash(name: str) -> str:
    return re.sub("[^a-z0-9]+", "", name.lower())


def region_of(sensor: str) -> tuple[str, str]:
    """(phrase, region id) of a sensor column name, decided on the driver."""
    blob = _squash(sensor)
    return next(((phrase, region) for key, phrase, region in SENSOR_REGIONS if key in blob), OTHER_REGION)


def display_of(sensor: str) -> str:
    """Sensor name with its short tag, unless the name is the tag."""
    blob = _squash(sensor)
    short = next((s for key, s in SENSOR_SHORT_NAMES if key in blob), "")
    return sensor if not short or _squash(short) == blob else f"{sensor} ({short})"
