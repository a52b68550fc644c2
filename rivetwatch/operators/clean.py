"""Cleaning: typing, de-duplication, filling, capping, binning, smoothing."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..constants import (
    ALL_SENSORS,
    CORE_SENSORS,
    DATE_NAME_HINTS,
    DERIVED_SUFFIXES,
    NULL_SENTINELS,
    SMOOTH_NAME_HINTS,
)
from ..functions.columns import Keys, as_double, nan_to_null, numeric_columns, string_columns
from ..functions.quantiles import quantiles
from ..session import kept
from .series import SeriesProfile, add_windowed, forward_fill, profile_series, rolling_mean, salted_lookup


# ---------------------------------------------------------------- shape
def trim_names(df: DataFrame) -> DataFrame:
    """Strip header blanks; of columns that end up with one name, keep the first."""
    names = [c.strip() for c in df.columns]
    if len(set(names)) == len(names):
        return df.toDF(*names)
    numbered = df.toDF(*[f"{i}__{n}" for i, n in enumerate(names)])
    first = {n: i for i, n in reversed(list(enumerate(names)))}
    kept = sorted(first.items(), key=lambda item: item[1])
    return numbered.select(*[F.col(f"`{i}__{n}`").alias(n) for n, i in kept])


def drop_empty_rows(df: DataFrame) -> DataFrame:
    return df.na.drop("all")


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """Exact duplicates, map-side combined: copies of one row meet as one partial row."""
    return df.dropDuplicates()


def fuse_sentinels(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """``NA``, ``--``, blank and friends become NULL in text columns."""
    cols = string_columns(df) if cols is None else cols
    return df.withColumns({c: F.when(~F.col(c).isin(*NULL_SENTINELS), F.col(c)) for c in cols}) if cols else df


# ---------------------------------------------------------------- schema repair
class TypePlan(NamedTuple):
    """Which text columns hold numbers and which hold timestamps."""

    numeric: list[str]
    datetime: list[str]


def plan_types(df: DataFrame, share: float = 0.8) -> TypePlan:
    """Decide all text columns with one aggregate (two or three counters per column)."""
    cols = string_columns(df)
    if not cols:
        return TypePlan([], [])
    dated = [c for c in cols if any(h in c.lower() for h in DATE_NAME_HINTS)]
    counters = []
    for c in cols:
        counters += [F.count(c).alias(f"n__{c}"), F.count(_try_double(c)).alias(f"d__{c}")]
    counters += [F.count(_try_timestamp(c)).alias(f"t__{c}") for c in dated]
    row = df.agg(*counters).first()
    numeric = [c for c in cols if row[f"n__{c}"] and row[f"d__{c}"] / row[f"n__{c}"] >= share]
    return TypePlan(numeric, [c for c in dated if c not in numeric and row[f"t__{c}"] > 0])


def apply_types(df: DataFrame, plan: TypePlan) -> DataFrame:
    casts = {c: _try_double(c) for c in plan.numeric} | {c: _try_timestamp(c) for c in plan.datetime}
    return df.withColumns(casts) if casts else df


def _try_double(c: str) -> Column:
    value = F.expr(f"try_cast(`{c}` AS DOUBLE)")
    return F.when(~F.isnan(value), value)


def _try_timestamp(c: str) -> Column:
    return F.expr(f"try_cast(`{c}` AS TIMESTAMP)")


# ---------------------------------------------------------------- sensor cleaning
def drop_bad_timestamps(df: DataFrame, keys: Keys = Keys()) -> DataFrame:
    """Rows whose time cannot be read are dropped.  No sort: windows state their own order."""
    if isinstance(df.schema[keys.ts].dataType, T.StringType):
        df = df.withColumn(keys.ts, _try_timestamp(keys.ts))
    return df.filter(F.col(keys.ts).isNotNull())


def trim_asset_ids(df: DataFrame, keys: Keys = Keys()) -> DataFrame:
    return df.withColumn(keys.id, F.trim(F.col(keys.id).cast("string")))


def coerce_sensors(df: DataFrame, extra: tuple = ("failure_within_days",), sensors=CORE_SENSORS) -> DataFrame:
    """Sensors and label as DOUBLE; unreadable text and NaN become NULL."""
    cols = [c for c in (*sensors, *extra) if c in df.columns]
    return df.withColumns({c: as_double(df, c) for c in cols}) if cols else df


def median_fill(df: DataFrame, cols: list[str], rows: int | None = None) -> DataFrame:
    """Fleet median for what is still missing: one statistics row, broadcast."""
    medians = quantiles(df, cols, [0.5], group_rows=rows)
    stats = medians.select(*[F.col(c)[0].alias(f"__{c}") for c in cols])
    out = df.crossJoin(F.broadcast(stats))
    return out.withColumns({c: F.coalesce(F.col(c), F.col(f"__{c}")) for c in cols}).select(*df.columns)


def winsorize(
    df: DataFrame, cols: list[str], guard_zero_iqr: bool = True, rows: int | None = None
) -> DataFrame:
    """Clip to 1.5 inter-quartile ranges, fleet-wide.

    With ``guard_zero_iqr`` a column whose quartiles coincide is left alone;
    without it such a column collapses to its quartile.
    """
    stats = quantiles(df, cols, [0.25, 0.75], group_rows=rows).select(
        *[F.col(c).alias(f"__{c}") for c in cols]
    )
    out = df.crossJoin(F.broadcast(stats))
    capped = {}
    for c in cols:
        q1, q3 = F.col(f"__{c}")[0], F.col(f"__{c}")[1]
        reach = 1.5 * (q3 - q1)
        clipped = F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), q1 - reach), q3 + reach))
        capped[c] = F.when(reach == 0, F.col(c)).otherwise(clipped) if guard_zero_iqr else clipped
    return out.withColumns(capped).select(*df.columns)


def clean_sensor_data(
    df: DataFrame,
    keys: Keys = Keys(),
    profile: SeriesProfile | None = None,
    guard_zero_iqr: bool = True,
) -> DataFrame:
    """Timestamps, ids, types, forward fill per asset, median fill, capping."""
    out = coerce_sensors(trim_asset_ids(drop_bad_timestamps(df, keys), keys))
    sensors = [c for c in CORE_SENSORS if c in out.columns]
    if not sensors:
        return out
    rows = profile.rows if profile else None
    # Medians, quartiles and the result each read the filled table: it is written once, the window runs once.
    out = kept(forward_fill(out, sensors, keys, profile), "filled")
    out = median_fill(out, sensors, rows)
    return winsorize(out, sensors, guard_zero_iqr, rows)


def clean_wide(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Columnar profile: headers, dedupe, sentinels, then median and guarded cap on all 22 sensors."""
    named = df.toDF(*[c.strip().replace(" ", "_") for c in df.columns])
    out = fuse_sentinels(drop_duplicate_rows(named))
    sensors = [c for c in ALL_SENSORS if c in out.columns]
    out = coerce_sensors(out, extra=(), sensors=ALL_SENSORS)
    if not sensors:
        return out
    # Every quantile and the result read the rows without copies: they are written once, copies are looked for once.
    out = kept(out, "wide")
    rows = out.count() if rows is None else rows
    return winsorize(median_fill(out, sensors, rows), sensors, True, rows)


# ---------------------------------------------------------------- imputation
def regression_impute(df: DataFrame, cols: list[str], keys: Keys = Keys(), min_values: int = 5) -> DataFrame:
    """Missing values from a straight line over event time, fitted per asset.

    Time is measured in hours from the fleet's first reading, which keeps the
    sums well conditioned.  An asset with fewer than ``min_values`` known
    values (or no spread in time) falls back to the fleet median.
    """
    micros = F.unix_micros(F.col(keys.ts).cast("timestamp"))
    start = df.agg(F.min(micros).alias("__t0"))
    timed = df.crossJoin(F.broadcast(start)).withColumn("__x", (micros - F.col("__t0")) / 3.6e9)
    fits = timed.groupBy(keys.id).agg(
        *[
            F.when(F.count(c) >= min_values, F.struct(
                F.regr_slope(c, "__x").alias("a"), F.regr_intercept(c, "__x").alias("b")
            )).alias(f"__f_{c}")
            for c in cols
        ]
    )
    medians = quantiles(df, cols, [0.5]).select(*[F.col(c)[0].alias(f"__m_{c}") for c in cols])
    out = timed.join(fits, keys.id, "left").crossJoin(F.broadcast(medians))
    filled = {
        c: F.coalesce(F.col(c), F.col(f"__f_{c}.a") * F.col("__x") + F.col(f"__f_{c}.b"), F.col(f"__m_{c}"))
        for c in cols
    }
    return out.withColumns(filled).select(*df.columns)


def mode_impute(df: DataFrame, cols: list[str]) -> DataFrame:
    """Most frequent text (smallest on a tie), or ``Unknown`` for an all-missing column.

    Counts per value are combined before they meet, so no task sees a whole column.
    """
    if not cols:
        return df
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in cols])).alias("x"))
    counts = long.select("x.*").filter(F.col("v").isNotNull()).groupBy("c", "v").count()
    # min over (-count, value): highest count first, then the smallest value.
    best = counts.agg(
        *[
            F.min(F.when(F.col("c") == c, F.struct((-F.col("count")).alias("n"), F.col("v").alias("v")))).alias(f"__{c}")
            for c in cols
        ]
    )
    out = df.crossJoin(F.broadcast(best))
    filled = {c: F.coalesce(F.col(c), F.col(f"__{c}.v"), F.lit("Unknown")) for c in cols}
    return out.withColumns(filled).select(*df.columns)


# ---------------------------------------------------------------- binning, scaling, smoothing
def quantile_bin(
    df: DataFrame, cols: list[str], q: int | None = None, suffix: str = "_bin", rows: int | None = None
) -> DataFrame:
    """Right-closed quantile intervals; equal edges merge.  Adds the label and ``_idx``.

    Without ``q`` each column gets ``min(5, max(2, distinct values))`` bins.
    """
    if q is None:
        wanted = _few_distinct(df, cols)
    else:
        wanted = {c: q for c in cols}
    fractions = {c: [i / n for i in range(n + 1)] for c, n in wanted.items()}
    every = sorted({p for ps in fractions.values() for p in ps})
    stats = quantiles(df, cols, every, group_rows=rows).select(
        *[
            F.array_sort(F.array_distinct(F.array(*[F.col(c)[every.index(p)] for p in fractions[c]]))).alias(f"__{c}")
            for c in cols
        ]
    )
    out = df.crossJoin(F.broadcast(stats))
    added = {}
    for c in cols:
        edges = F.col(f"__{c}")
        # Edges below the value; the lowest edge belongs to the first interval.
        below = F.size(F.filter(edges, lambda e: e < F.col(c)))
        idx = F.when(F.col(c).isNotNull() & (F.size(edges) > 1), F.greatest(below, F.lit(1)) - 1)
        added[f"{c}{suffix}_idx"] = idx
        left, right = F.get(edges, idx), F.get(edges, idx + 1)
        added[f"{c}{suffix}"] = F.when(
            idx.isNotNull(),
            F.concat(F.lit("("), F.format_string("%.3f", left), F.lit(", "), F.format_string("%.3f", right), F.lit("]")),
        )
    return out.withColumns(added).select(*df.columns, *added)


def _few_distinct(df: DataFrame, cols: list[str], most: int = 5) -> dict[str, int]:
    """Exact number of distinct values per column, as far as ``most``; at least 2."""
    rough = df.agg(*[F.approx_count_distinct(c, 0.02).alias(c) for c in cols]).first()
    counts = {c: most for c in cols}
    # A sketch far above the limit settles the column; only near it is the exact count needed.
    unsure = [c for c in cols if rough[c] <= 10 * most]
    if unsure:
        row = df.agg(*[F.count_distinct(c).alias(c) for c in unsure]).first()
        counts.update({c: row[c] for c in unsure})
    return {c: min(most, max(2, counts[c])) for c in cols}


def z_normalize(df: DataFrame, cols: list[str], suffix: str = "_z") -> DataFrame:
    stats = df.agg(
        *[F.struct(F.avg(c).alias("mu"), F.stddev_samp(c).alias("sd")).alias(f"__{c}") for c in cols]
    )
    out = df.crossJoin(F.broadcast(stats))
    scaled = {f"{c}{suffix}": (F.col(c) - F.col(f"__{c}.mu")) / (F.col(f"__{c}.sd") + 1e-9) for c in cols}
    return out.withColumns(scaled).select(*df.columns, *scaled)


def smooth(
    df: DataFrame,
    cols: list[str],
    window: int | None = None,
    suffix: str = "_smooth",
    rule: tuple = (5, 2, 10),
    keys: Keys = Keys(),
    profile: SeriesProfile | None = None,
) -> DataFrame:
    """Rolling mean per asset.

    Without ``window`` an asset with n rows uses ``min(cap, max(floor, n // div))``
    for ``rule = (cap, floor, div)``; the lab profile is ``(12, 3, 20)``.
    """
    if window is not None:
        return add_windowed(df, {f"{c}{suffix}": rolling_mean(c, window) for c in cols}, window - 1, keys, profile)
    cap, floor, div = rule
    sizes = df.groupBy(keys.id).agg(
        F.least(F.lit(cap), F.greatest(F.lit(floor), F.floor(F.count(F.lit(1)) / div).cast("int"))).alias("__w")
    )
    profile = profile or profile_series(df, keys)
    sized = salted_lookup(df, sizes, keys.id, profile.max_rows)
    # One window column per candidate length: they share the exchange and the sort.
    made = {f"__{c}_{n}": rolling_mean(c, n) for c in cols for n in range(floor, cap + 1)}
    out = add_windowed(sized, made, cap - 1, keys, profile)
    picked = {}
    for c in cols:
        e = F.lit(None).cast("double")
        for n in range(floor, cap + 1):
            e = F.when(F.col("__w") == n, F.col(f"__{c}_{n}")).otherwise(e)
        picked[f"{c}{suffix}"] = e
    return out.withColumns(picked).select(*df.columns, *picked)


def smoothable(df: DataFrame) -> list[str]:
    return [
        c
        for c in numeric_columns(df)
        if any(h in c.lower() for h in SMOOTH_NAME_HINTS) and not c.endswith(DERIVED_SUFFIXES)
    ]


def industrial_clean(
    df: DataFrame, keys: Keys = Keys(), profile: SeriesProfile | None = None, bins: int | None = None
) -> DataFrame:
    """The full cleaning chain in the fixed order: shape, types, filling, bins (of all numbers, or the first ``bins``), smoothing."""
    out = nan_to_null(drop_duplicate_rows(drop_empty_rows(trim_names(df))))
    out = fuse_sentinels(out)
    out = apply_types(out, plan_types(out))
    numbers = [c for c in numeric_columns(out) if c != keys.tie]
    out = regression_impute(out, numbers, keys)
    out = mode_impute(out, [c for c in string_columns(out) if c != keys.id])
    out = quantile_bin(out, numbers[:bins])
    return smooth(out, smoothable(out), keys=keys, profile=profile)


# ---------------------------------------------------------------- log
def clean_log(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """What cleaning would touch, as rows ``(step, column, n)`` from one aggregate per pass."""
    cols = cols or [c for c in CORE_SENSORS if c in df.columns]
    q = quantiles(df, cols, [0.25, 0.75]).select(*[F.col(c).alias(f"__{c}") for c in cols])
    joined = df.crossJoin(F.broadcast(q))

    def outside(c):
        q1, q3 = F.col(f"__{c}")[0], F.col(f"__{c}")[1]
        reach = 1.5 * (q3 - q1)
        return (reach != 0) & ((F.col(c) < q1 - reach) | (F.col(c) > q3 + reach))

    counts = joined.agg(
        *[F.count_if(F.col(c).isNull()).alias(f"null__{c}") for c in cols],
        *[F.count_if(outside(c)).alias(f"cap__{c}") for c in cols],
    )
    rows = [
        F.struct(F.lit(step).alias("step"), F.lit(c).alias("column"), F.col(f"{key}__{c}").alias("n"))
        for step, key in (("median fill", "null"), ("iqr cap", "cap"))
        for c in cols
    ]
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*").filter("n > 0")
