"""Ordered per-asset windows that stay balanced when one asset is huge.

A window ``PARTITION BY asset ORDER BY ts, tie`` puts a whole asset in one
task.  That is the best plan while every asset is of ordinary size, and it is
what runs then.  When one asset holds a large share of all rows, its history
(and no other asset's) is cut into time slices and the window runs per ``(asset, slice)``:

* frames that look back at most ``k`` rows get the last ``k`` rows before the
  slice as *context rows*, which are dropped again afterwards;
* "last known value" gets one carried value per slice and column.

Both forms give the same rows.  ``profile_series`` decides from one cheap
aggregate over the key columns.
"""

from __future__ import annotations

from typing import Callable, NamedTuple

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F, types as T

from ..functions.columns import Keys

# An asset above this many rows is cut into slices of about this size.
TARGET_ROWS = 4_000_000
_SLICE, _HOT = "__slice", "__hot"
_LEAST_WIDTH = 1e-6
_TRAIN_PARTS = 64


class SeriesProfile(NamedTuple):
    """How rows spread over assets; ``slice_seconds`` is None when no cut is needed.

    ``hot`` names the assets to cut and their slice widths (at most one per ``target_rows`` rows of the table);
    without it ``slice_seconds`` cuts every asset.
    """

    rows: int
    assets: int
    max_rows: int
    slice_seconds: float | None = None
    hot: tuple[tuple[str, float], ...] | None = None


def profile_series(df: DataFrame, keys: Keys = Keys(), target_rows: int = TARGET_ROWS) -> SeriesProfile:
    """One map-side-combined aggregate over (id, ts); returns a handful of numbers."""
    micros = F.unix_micros(F.col(keys.ts).cast("timestamp"))
    per_asset = df.groupBy(keys.id).agg(
        F.count(F.lit(1)).alias("n"), ((F.max(micros) - F.min(micros)) / 1e6).alias("span")
    )
    large = F.when(F.col("n") > target_rows, F.struct(F.col(keys.id).alias("id"), (F.col("span") * target_rows / F.col("n")).alias("width")))
    row = per_asset.agg(
        F.sum("n").alias("rows"),
        F.count(F.lit(1)).alias("assets"),
        F.max("n").alias("max_rows"),
        F.collect_list(large).alias("hot"),  # one entry per ``target_rows`` rows at most
    ).first()
    if not row["hot"]:
        return SeriesProfile(row["rows"] or 0, row["assets"], row["max_rows"] or 0)
    hot = _settle_widths(df, keys, {h["id"]: max(h["width"] or 0.0, _LEAST_WIDTH) for h in row["hot"]}, target_rows)
    return SeriesProfile(row["rows"] or 0, row["assets"], row["max_rows"] or 0, min(hot.values()), tuple(sorted(hot.items())))


def _settle_widths(df: DataFrame, keys: Keys, widths: dict[str, float], target_rows: int) -> dict[str, float]:
    """Bursty assets need narrower slices than their mean rate suggests: shrink until each fits.

    Every round at least halves the widths that don't fit, down to a microsecond: rows of one time stay together.
    """
    open_ = dict(widths)
    while open_:
        counts = _cut(df, keys, tuple(open_.items())).filter(F.col(_HOT)).groupBy(keys.id, _SLICE).count()
        biggest = {r[0]: r["n"] for r in counts.groupBy(keys.id).agg(F.max("count").alias("n")).collect()}
        open_ = {a: max(w * target_rows / biggest[a], _LEAST_WIDTH) for a, w in open_.items() if biggest.get(a, 0) > 2 * target_rows and w > _LEAST_WIDTH}
        widths |= open_
    return widths


def _cut(df: DataFrame, keys: Keys, hot: tuple[tuple[str, float], ...]) -> DataFrame:
    """Slice number by the width of each hot asset, 0 for all others; and which rows are of a hot asset."""
    schema = T.StructType([T.StructField("__of", df.schema[keys.id].dataType), T.StructField("__width", T.DoubleType())])
    widths = df.sparkSession.createDataFrame(list(hot), schema)
    micros = F.unix_micros(F.col(keys.ts).cast("timestamp"))
    out = df.join(F.broadcast(widths), F.col(keys.id) == F.col("__of"), "left")
    number = F.when(F.col("__width").isNotNull(), F.floor(micros / (F.col("__width") * 1e6)).cast("long")).otherwise(F.lit(0).cast("long"))
    return out.withColumn(_SLICE, number).withColumn(_HOT, F.col("__width").isNotNull()).drop("__of", "__width")


def _slice_index(keys: Keys, width: float) -> Column:
    micros = F.unix_micros(F.col(keys.ts).cast("timestamp"))
    return F.floor(micros / F.lit(width * 1e6)).cast("long").alias(_SLICE)


def _slices(df: DataFrame, keys: Keys, profile: SeriesProfile | None) -> DataFrame | None:
    """``df`` with slice numbers, or None where no asset needs a cut."""
    if profile is None:
        profile = profile_series(df, keys)
    if profile.slice_seconds is None:
        return None
    if profile.hot is None:
        return df.withColumn(_SLICE, _slice_index(keys, profile.slice_seconds))
    return _cut(df, keys, profile.hot).drop(_HOT)


def add_windowed(
    df: DataFrame,
    exprs: dict[str, Callable[[WindowSpec], Column]],
    look_back: int,
    keys: Keys = Keys(),
    profile: SeriesProfile | None = None,
) -> DataFrame:
    """Add columns computed over each asset's ordered rows.

    Every expression gets the ordered window and may look back at most
    ``look_back`` rows.  All of them share one exchange and one sort.
    """
    cut = _slices(df, keys, profile)
    if cut is None:
        w = Window.partitionBy(keys.id).orderBy(*keys.order)
        return df.withColumns({name: make(w) for name, make in exprs.items()})

    # Stated outright: a table already hashed by asset would otherwise keep its hot partition.
    cut = cut.repartition(keys.id, _SLICE)
    w = Window.partitionBy(keys.id, _SLICE).orderBy(*keys.order)
    both = cut.withColumn("__context", F.lit(False)).unionByName(
        _context_rows(cut, look_back, keys).withColumn("__context", F.lit(True))
    )
    out = both.withColumns({name: make(w) for name, make in exprs.items()})
    return out.filter(~F.col("__context")).drop(_SLICE, "__context")


def _context_rows(cut: DataFrame, look_back: int, keys: Keys) -> DataFrame:
    """The last ``look_back`` rows before each non-empty slice, labelled with that slice."""
    newest_first = Window.partitionBy(keys.id, _SLICE).orderBy(*[F.col(c).desc() for c in keys.order])
    names = [c for c in cut.columns if c != _SLICE]
    tails = (
        cut.withColumn("__rn", F.row_number().over(newest_first))
        .filter(F.col("__rn") <= look_back)
        .groupBy(keys.id, _SLICE)
        .agg(F.sort_array(F.collect_list(F.struct(keys.ts, keys.tie, F.struct(*names).alias("r")))).alias("tail"))
    )
    # ``look_back`` earlier slices hold at least ``look_back`` rows, as empty slices do not exist.
    earlier = Window.partitionBy(keys.id).orderBy(_SLICE).rowsBetween(-look_back, -1)
    joined = F.flatten(F.collect_list("tail").over(earlier))
    recent = F.when(F.size(joined) > look_back, F.slice(joined, -look_back, look_back)).otherwise(joined)
    return (
        tails.select(F.col(_SLICE), recent.alias("recent"))
        .select(_SLICE, F.explode("recent").alias("x"))
        .select("x.r.*", _SLICE)
    )


def forward_fill(
    df: DataFrame, cols: list[str], keys: Keys = Keys(), profile: SeriesProfile | None = None
) -> DataFrame:
    """Last known value per asset and column, in (ts, tie) order."""
    cut = _slices(df, keys, profile)
    if cut is None:
        w = Window.partitionBy(keys.id).orderBy(*keys.order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})

    # Last known value of each slice, straight from the scan with map-side combine.
    ends = cut.groupBy(keys.id, _SLICE).agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), keys.stamp())).alias(c) for c in cols]
    )
    before = Window.partitionBy(keys.id).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        F.col(keys.id), F.col(_SLICE), *[F.last(c, ignorenulls=True).over(before).alias(f"__{c}") for c in cols]
    )
    w = Window.partitionBy(keys.id, _SLICE).orderBy(*keys.order).rowsBetween(Window.unboundedPreceding, 0)
    spread = cut.repartition(keys.id, _SLICE)
    filled = spread.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})
    out = filled.join(carried, [keys.id, _SLICE], "left")
    out = out.withColumns({c: F.coalesce(F.col(c), F.col(f"__{c}")) for c in cols})
    return out.select(*df.columns)


def salted_lookup(df: DataFrame, small: DataFrame, key: str, group_rows: int) -> DataFrame:
    """Inner join of rows with a one-row-per-key table, balanced for a key of ``group_rows`` rows.

    Only keys above the target size are spread over salts, and only their small rows are copied; there is at most one
    such key per ``TARGET_ROWS`` rows.  Without any, tables join plainly.
    """
    if group_rows <= TARGET_ROWS:
        return df.join(small, key)
    counts = df.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / TARGET_ROWS).cast("int").alias("__salts"))
    hot = F.broadcast(counts.filter("__salts > 1"))
    salts = F.coalesce("__salts", F.lit(1))
    hashed = F.pmod(F.xxhash64(*[c for c in df.columns if c != key]), salts).cast("int")
    rows = df.join(hot, key, "left").withColumn("__salt", hashed).drop("__salts")
    copies = small.join(hot, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("__salts")
    return rows.join(copies, [key, "__salt"]).drop("__salt")


# ---------------------------------------------------------------- ready-made windows
def rolling_mean(col: str, window: int):
    return lambda w: F.avg(col).over(w.rowsBetween(1 - window, 0))


def rolling_std(col: str, window: int):
    return lambda w: F.coalesce(F.stddev_samp(col).over(w.rowsBetween(1 - window, 0)), F.lit(0.0))


def step(col: str):
    """Change since the asset's previous row; NULL on its first row."""
    return lambda w: F.col(col) - F.lag(col).over(w)


def latest_per_asset(df: DataFrame, cols: list[str] | None = None, keys: Keys = Keys()) -> DataFrame:
    """Newest row per asset by partial aggregation: no sort, no per-asset task."""
    cols = cols or [c for c in df.columns if c != keys.id]
    picked = df.groupBy(keys.id).agg(F.max_by(F.struct(*cols), keys.stamp()).alias("r"))
    return picked.select(keys.id, "r.*")


def last_rows(df: DataFrame, n: int, keys: Keys = Keys()) -> DataFrame:
    """Last ``n`` rows per asset.  Spark trims to ``n`` per asset before the shuffle (window group limit)."""
    w = Window.partitionBy(keys.id).orderBy(*[F.col(c).desc() for c in keys.order])
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).drop("__rn")


def spread_rows(df: DataFrame, *by: str) -> DataFrame:
    """Training rows in a fixed number of hash partitions, persisted; the caller releases them.

    A fixed number and a hash of the row keep a trained model the same on any machine and for any input layout.
    """
    return df.repartition(_TRAIN_PARTS, *by).persist()
