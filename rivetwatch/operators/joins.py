"""Table integration: two-table joins, chains, and per-asset attachment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import Keys
from ..functions.scalars import is_valid_asset

HOW = {"inner": "inner", "left": "left", "right": "right", "outer": "full"}
PREFERRED_KEYS = ("machine_id", "asset_id", "id", "timestamp", "date")


def suggest_join_keys(left: DataFrame, right: DataFrame) -> list[str]:
    """Shared names, preferred ones first, each part sorted."""
    shared = sorted(set(left.columns) & set(right.columns))
    return sorted(shared, key=lambda c: (c.lower() not in PREFERRED_KEYS, c))


def join_two(
    left: DataFrame,
    right: DataFrame,
    how: str = "inner",
    on: list[str] | None = None,
    left_on: str | None = None,
    right_on: str | None = None,
    suffixes: tuple[str, str] = ("_l", "_r"),
    null_safe: bool = False,
) -> DataFrame:
    """Equi-join in one of four flavours.

    Key choice: ``on``, else ``left_on``/``right_on`` (both columns stay), else
    the first suggested key.  Clashing non-key columns get suffixes.  SQL null
    rules apply unless ``null_safe`` asks for missing keys to match each other.
    Join strategy and skew splitting are left to adaptive execution, which
    decides from measured sizes.
    """
    if how not in HOW:
        raise ValueError(f"unsupported join type {how!r}; use one of {sorted(HOW)}")
    if not on and not (left_on and right_on):
        on = suggest_join_keys(left, right)[:1]
        if not on:
            raise ValueError("no common columns to join on; pass left_on and right_on")
    keys = list(on or [])
    clash = (set(left.columns) & set(right.columns)) - set(keys)
    left = left.withColumnsRenamed({c: c + suffixes[0] for c in clash})
    right = right.withColumnsRenamed({c: c + suffixes[1] for c in clash})
    if not keys:
        a = left[left_on + suffixes[0] if left_on in clash else left_on]
        b = right[right_on + suffixes[1] if right_on in clash else right_on]
        return left.join(right, a.eqNullSafe(b) if null_safe else a == b, HOW[how])
    if not null_safe:
        return left.join(right, keys, HOW[how])
    hidden = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    match = reduce(Column.__and__, [left[k].eqNullSafe(hidden[f"__{k}"]) for k in keys])
    joined = left.join(hidden, match, HOW[how])
    merged = joined.withColumns({k: F.coalesce(F.col(k), F.col(f"__{k}")) for k in keys})
    return merged.drop(*[f"__{k}" for k in keys])


def join_many(tables: dict[str, DataFrame], steps: list[dict]) -> DataFrame:
    """Fold join steps; the running result is the left side of every later step."""
    if not tables or not steps:
        raise ValueError("tables and at least one join step are required")
    working = tables[steps[0]["left"]]
    for step in steps:
        if step["right"] not in tables and step["right"] != "_result":
            raise KeyError(f"unknown right table: {step['right']}")
        right = working if step["right"] == "_result" else tables[step["right"]]
        options = {k: step[k] for k in ("on", "left_on", "right_on", "null_safe") if k in step}
        working = join_two(working, right, step.get("how", "inner"), **options)
    return working


def join_report(left: DataFrame, right: DataFrame, joined: DataFrame, how: str, on: list[str]) -> DataFrame:
    """Row counts of both sides and of the result: three counters, one row."""
    def n(df, name):
        return df.agg(F.count(F.lit(1)).alias(name))

    counts = n(left, "left_rows").crossJoin(F.broadcast(n(right, "right_rows")))
    counts = counts.crossJoin(F.broadcast(n(joined, "result_rows")))
    return counts.select(F.lit(how).alias("how"), F.lit(",".join(on)).alias("join_keys"), "*")


def asset_spine(sources: list[DataFrame], keys: Keys = Keys()) -> DataFrame:
    """Distinct valid asset ids over all sources; duplicates meet on the map side first."""
    ids = [df.select(F.trim(F.col(keys.id).cast("string")).alias(keys.id)) for df in sources]
    return reduce(DataFrame.unionByName, ids).filter(is_valid_asset(F.col(keys.id))).distinct()


def merge_by_asset(slots: dict[str, DataFrame], newest: dict[str, DataFrame] | None = None, keys: Keys = Keys()) -> DataFrame:
    """Full outer merge of many tables on the asset id with one shuffle.

    ``slots`` have at most one row per asset; ``newest`` have any number, of
    which the newest by (ts, tie) is kept.  Every table becomes one struct
    column of its name (NULL where it lacks the asset).  Rows are stacked and
    grouped once, so partial results combine before they move; a chain of
    joins would shuffle once per table.
    """
    newest = newest or {}
    asset = F.trim(F.col(keys.id).cast("string")).alias(keys.id)
    parts, aggs = [], []
    for name, df in slots.items():
        cols = [c for c in df.columns if c != keys.id]
        parts.append(df.select(asset, F.struct(*cols).alias(name)))
        aggs.append(F.first(name, ignorenulls=True).alias(name))
    for name, df in newest.items():
        cols = [c for c in df.columns if c not in (keys.id, keys.tie)]
        parts.append(df.select(asset, F.struct(*cols).alias(name), keys.stamp().alias(f"__at_{name}")))
        aggs.append(F.max_by(name, f"__at_{name}").alias(name))
    stacked = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
    return stacked.filter(is_valid_asset(F.col(keys.id))).groupBy(keys.id).agg(*aggs)


def filter_assets(df: DataFrame, chosen, keys: Keys = Keys()) -> DataFrame:
    """Keep chosen assets: a literal list becomes a pushed-down filter, a table a semi join."""
    if isinstance(chosen, DataFrame):
        return df.join(chosen.select(keys.id), keys.id, "left_semi")
    return df.filter(F.col(keys.id).isin(list(chosen))) if chosen else df


def attach_predictions(df: DataFrame, predictions: DataFrame, keys: Keys = Keys()) -> DataFrame:
    """Put every asset's RUL and risk on all of its rows.

    The per-asset side can be large, so it is not forced to broadcast: adaptive
    execution broadcasts it when its measured size allows, and splits hot
    partitions of the row side otherwise.
    """
    small = predictions.select(keys.id, "predicted_rul_days", "risk_level")
    return df.drop("predicted_rul_days", "risk_level").join(small, keys.id, "left")
