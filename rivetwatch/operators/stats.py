"""Profiles and statistics of a table: columns, correlations, histograms, boxes."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..constants import CORE_SENSORS
from ..functions.columns import Keys, numeric_columns
from ..functions.quantiles import largest_group, quantiles
from .distinct import distinct_counts
from .series import salted_lookup


# ---------------------------------------------------------------- column profile
def column_profile(df: DataFrame, exact_distinct: bool = True) -> DataFrame:
    """One row per column: type class, nulls, distinct values, numeric summary, score."""
    fields = df.schema.fields
    numbers = numeric_columns(df)
    aggs = [F.count(F.lit(1)).alias("__n")]
    for f in fields:
        c = f.name
        aggs.append(F.count(c).alias(f"{c}__known"))
        if not exact_distinct:
            aggs.append(F.approx_count_distinct(c).alias(f"{c}__distinct"))
        if c in numbers:
            aggs += [
                F.avg(c).alias(f"{c}__mean"), F.stddev_samp(c).alias(f"{c}__std"),
                F.min(c).cast("double").alias(f"{c}__min"), F.max(c).cast("double").alias(f"{c}__max"),
            ]
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            aggs += [F.min(c).cast("string").alias(f"{c}__from"), F.max(c).cast("string").alias(f"{c}__to")]
    row = df.agg(*aggs)
    if exact_distinct:
        row = row.crossJoin(F.broadcast(distinct_counts(df)))
    if numbers:
        medians = quantiles(df, numbers, [0.5]).select(*[F.col(c)[0].alias(f"{c}__median") for c in numbers])
        row = row.crossJoin(F.broadcast(medians))

    nothing = F.lit(None).cast("double")
    no_text = F.lit(None).cast("string")

    def line(f) -> Column:
        c = f.name
        is_number = c in numbers
        is_time = isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))
        nulls = F.col("__n") - F.col(f"{c}__known")
        null_pct = F.round(100.0 * nulls / F.greatest(F.col("__n"), F.lit(1)), 2)

        def number(part):
            return (F.round(F.col(f"{c}__{part}"), 4) if is_number else nothing).alias(part)

        return F.struct(
            F.lit(c).alias("column"),
            F.lit("numeric" if is_number else "datetime" if is_time else "categorical").alias("kind"),
            nulls.alias("null_count"),
            null_pct.alias("null_pct"),
            F.col(f"{c}__distinct").alias("unique_count"),
            number("mean"), number("std"), number("min"), number("max"), number("median"),
            (F.col(f"{c}__from") if is_time else no_text).alias("first_time"),
            (F.col(f"{c}__to") if is_time else no_text).alias("last_time"),
            F.round(100 - null_pct, 1).alias("quality_score"),
        )

    return row.select(F.explode(F.array(*[line(f) for f in fields])).alias("r")).select("r.*")


def table_score(profile: DataFrame) -> DataFrame:
    return profile.agg(F.round(F.avg(100 - F.col("null_pct")), 1).alias("quality_score"))


def top_values(df: DataFrame, cols: list[str], k: int = 5) -> DataFrame:
    """Most frequent values per column; equal counts resolve to the smaller value."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])
    counts = (
        df.select(F.explode(cells).alias("x")).select("x.*")
        .filter(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    )
    w = Window.partitionBy("column").orderBy(F.col("n").desc(), "value")
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


# What a table should have, and what to say where it hasn't.
_WANTED = (
    (lambda have: sum(c in have for c in CORE_SENSORS) >= 2, "Two or more sensor columns make models worth fitting."),
    (lambda have: "timestamp" in have, "Without a timestamp column, rows have no order: add one."),
    (lambda have: "machine_id" in have, "Rows can't be told apart by asset: add machine_id."),
    (lambda have: "failure_within_days" in have, "Days to failure are unknown, so remaining life is estimated from wear."),
)


def profile_recommendations(df: DataFrame) -> list[str]:
    """Advice from the schema alone, one sentence for each rule that the columns don't meet."""
    return [advice for met, advice in _WANTED if not met(df.columns)]


def recommendation_rows(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    rows = [(i + 1, text) for i, text in enumerate(profile_recommendations(df))]
    return spark.createDataFrame(rows, "position int, recommendation string")


# ---------------------------------------------------------------- plain aggregates
def asset_means(df: DataFrame, cols: list[str], keys: Keys = Keys()) -> DataFrame:
    return df.groupBy(keys.id).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"avg_{c}") for c in cols])


def describe_sensors(df: DataFrame, cols: list[str]) -> DataFrame:
    row = df.agg(
        *[
            F.struct(
                F.lit(c).alias("sensor"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
                F.min(c).alias("min"), F.max(c).alias("max"),
            ).alias(f"s{i}")
            for i, c in enumerate(cols)
        ]
    )
    return row.select(F.explode(F.array(*[f"s{i}" for i in range(len(cols))])).alias("r")).select("r.*")


def rows_per_asset(df: DataFrame, keys: Keys = Keys()) -> DataFrame:
    return df.groupBy(keys.id).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), keys.id)


def duplicate_counts(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Rows beyond the first of each group of equals."""
    groups = df.groupBy(*(subset or df.columns)).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("dup_rows"))


# ---------------------------------------------------------------- correlation
def safe_corr(a: str, b: str) -> Column:
    """Pearson r over complete pairs; NULL when either side has no spread."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
    # covar / std instead of corr(): a constant column must give NULL, not an error.
    return F.covar_samp(x, y) / F.nullif(F.stddev_samp(x) * F.stddev_samp(y), F.lit(0.0))


def correlation_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """All pairs in one aggregate; long form, both directions and the diagonal."""
    pairs = list(combinations_with_replacement(cols, 2))
    row = df.agg(*[safe_corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    cells = []
    for i, (a, b) in enumerate(pairs):
        for x, y in {(a, b), (b, a)}:
            cells.append(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"r{i}").alias("corr")))
    return row.select(F.explode(F.array(*cells)).alias("r")).select("r.*")


def slope_reading(df: DataFrame, x: str, y: str) -> DataFrame:
    """Line and correlation of y against x; empty verdict under five pairs."""
    row = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope(F.col(y), F.col(x)).alias("slope"), safe_corr(x, y).alias("corr")
    )
    enough = F.col("n") >= 5
    return row.select(
        F.lit(x).alias("x"), F.lit(y).alias("y"), "n",
        F.when(enough, F.col("slope")).alias("slope"),
        F.when(enough, F.col("corr")).alias("corr"),
        F.when(enough, F.when(F.col("slope") > 0, "rising").otherwise("falling")).alias("direction"),
    )


def group_gap(df: DataFrame, x: str, y: str) -> DataFrame:
    """Groups with the highest and lowest mean, and the gap between them."""
    means = df.filter(F.col(y).isNotNull()).groupBy(x).agg(F.avg(y).alias("m"))
    key = F.struct("m", F.col(x))
    return means.agg(
        F.max_by(x, key).alias("high"), F.max("m").alias("high_mean"),
        F.min_by(x, key).alias("low"), F.min("m").alias("low_mean"),
        (F.max("m") - F.min("m")).alias("gap"), F.count(F.lit(1)).alias("groups"),
    )


# ---------------------------------------------------------------- distributions
def histogram(df: DataFrame, col: str, bins: int = 30, by: str | None = None) -> DataFrame:
    """Equal-width bins over the whole range; the top edge belongs to the last bin."""
    span = df.agg(F.min(col).alias("__lo"), F.max(col).alias("__hi"))
    width = (F.col("__hi") - F.col("__lo")) / bins
    slot = F.when(width == 0, 0).otherwise(
        F.least(F.lit(bins - 1), F.floor((F.col(col) - F.col("__lo")) / F.nullif(width, F.lit(0.0))))
    ).cast("int")
    rows = df.filter(F.col(col).isNotNull()).crossJoin(F.broadcast(span))
    groups = [by] if by else []
    counts = rows.groupBy(*groups, slot.alias("bin"), "__lo", width.alias("__w")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(
        *groups, "bin",
        (F.col("__lo") + F.col("bin") * F.col("__w")).alias("bin_start"),
        (F.col("__lo") + (F.col("bin") + 1) * F.col("__w")).alias("bin_end"), "n",
    )


def box_summary(df: DataFrame, col: str, keys: Keys = Keys(), group_rows: int | None = None) -> DataFrame:
    """Quartiles, whiskers (furthest value within 1.5 IQR) and outlier count per asset."""
    group_rows = largest_group(df, [keys.id]) if group_rows is None else group_rows
    q = quantiles(df, [col], [0.25, 0.5, 0.75], [keys.id], group_rows).select(
        keys.id, F.col(col)[0].alias("q1"), F.col(col)[1].alias("median"), F.col(col)[2].alias("q3")
    )
    rows = salted_lookup(df.select(keys.id, keys.tie, col), q, keys.id, group_rows)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col(col) >= F.col("q1") - reach) & (F.col(col) <= F.col("q3") + reach)
    return rows.groupBy(keys.id, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col(col))).alias("whisker_low"),
        F.max(F.when(inside, F.col(col))).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"),
    )


def box_outliers(df: DataFrame, col: str, keys: Keys = Keys(), group_rows: int | None = None) -> DataFrame:
    """Every point outside the whiskers."""
    box = box_summary(df, col, keys, group_rows)
    return df.join(box, keys.id).filter(
        (F.col(col) < F.col("whisker_low")) | (F.col(col) > F.col("whisker_high"))
    ).select(keys.id, keys.ts, keys.tie, col)


def pivot_latest(df: DataFrame, col: str, assets: list[str], keys: Keys = Keys()) -> DataFrame:
    """Time by asset table of the last value; the asset list is explicit, so the width is known."""
    return (
        df.filter(F.col(keys.id).isin(assets) & F.col(col).isNotNull())
        .groupBy(keys.ts).pivot(keys.id, assets).agg(F.max_by(col, keys.tie))
    )


def latest_by_time(df: DataFrame, col: str, keys: Keys = Keys(), arrival: str | None = None) -> DataFrame:
    """Long form of the same: last arrival per (time, asset)."""
    return df.filter(F.col(col).isNotNull()).groupBy(keys.ts, keys.id).agg(
        F.max_by(col, arrival or keys.tie).alias(col)
    )


# ---------------------------------------------------------------- sets
def append(buffer: DataFrame, batch: DataFrame) -> DataFrame:
    """Union of all rows; columns missing on one side are NULL there."""
    return buffer.unionByName(batch, allowMissingColumns=True)


def flagged_first(df: DataFrame, flag: str, most: int = 400, keys: Keys = Keys()) -> DataFrame:
    """Report sample: up to half flagged rows, the rest unflagged, newest first."""
    newest = [F.col(c).desc() for c in keys.order]
    flagged = df.filter(F.col(flag)).orderBy(*newest).limit(most // 2).withColumn("__o", F.lit(0))
    rest = df.filter(~F.col(flag)).orderBy(*newest).limit(most).withColumn("__o", F.lit(1))
    return flagged.unionByName(rest).orderBy("__o", *newest).limit(most).drop("__o")
