"""Windows over a table without an asset column: one order over all rows, many tasks.

``Window.orderBy`` without keys puts the whole table into one task.  Here the order is cut instead: one range exchange
sorts the rows, counts of its partitions (one row each) turn into exact positions, and positions cut the order into
slices of equal size.  A slice gets the few rows before it as a halo; what reaches back further (last known value,
running totals) is carried from slice to slice by one number per slice and column.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from ..session import kept
from .series import TARGET_ROWS

POSITION = "__position"
_SLICE, _HALO = "__slice", "__halo"


def positions(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with ``__position``: 0, 1, 2 .. by ``order`` (nulls first); rows equal in it stand in any order, but fixed.

    The ordered rows are written once to the shared folder: all that reads them sees the same positions.
    """
    by = [F.col(c).asc_nulls_first() for c in order]
    laid = df.withColumn("__own", F.monotonically_increasing_id())
    by.append(F.col("__own").asc())
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = laid.repartitionByRange(parts, *by).sortWithinPartitions(*by).drop("__own")
    laid = kept(laid.withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__at", 33)), "whole-order")
    counts = laid.groupBy("__part").agg(F.count(F.lit(1)).alias("n"), F.min("__at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = counts.select("__part", (before - F.col("first")).alias("__shift"))  # one row per partition of the exchange
    return laid.join(F.broadcast(shift), "__part").select(*df.columns, (F.col("__at") + F.col("__shift")).alias(POSITION))


def _sliced(df: DataFrame, order: list[str], size: int) -> DataFrame:
    return positions(df, order).withColumn(_SLICE, F.floor(F.col(POSITION) / size))


def add_windowed_whole(
    df: DataFrame, exprs: dict[str, Callable[[WindowSpec], Column]], look_back: int, order: list[str], rows_per_slice: int = TARGET_ROWS
) -> DataFrame:
    """Add columns computed over all rows in ``order``; expressions get the window and look back ``look_back`` rows at most.

    No task holds more than ``rows_per_slice`` and ``look_back`` rows.  Empty tables stay empty.
    """
    size = max(rows_per_slice, look_back, 1)
    cut = _sliced(df, order, size)
    # The last rows of each slice are the halo of the next.
    halo = cut.filter(F.col(POSITION) % size >= size - look_back).withColumn(_SLICE, F.col(_SLICE) + 1)
    both = cut.withColumn(_HALO, F.lit(False)).unionByName(halo.withColumn(_HALO, F.lit(True)))
    w = Window.partitionBy(_SLICE).orderBy(POSITION)
    out = both.withColumns({name: make(w) for name, make in exprs.items()})
    return out.filter(~F.col(_HALO)).drop(_SLICE, _HALO, POSITION)


def _carried(cut: DataFrame, per_slice: dict[str, Column], over: Callable[[str, WindowSpec], Column]) -> DataFrame:
    """One row per slice: each value folded over all slices before it."""
    ends = cut.groupBy(_SLICE).agg(*[c.alias(f"__{k}") for k, c in per_slice.items()])
    before = Window.orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    return ends.select(_SLICE, *[over(f"__{k}", before).alias(f"__{k}") for k in per_slice])


def forward_fill_whole(df: DataFrame, cols: list[str], order: list[str], rows_per_slice: int = TARGET_ROWS) -> DataFrame:
    """Last known value of each column over all rows in ``order``; null before the first known one."""
    cut = _sliced(df, order, rows_per_slice)
    last = {c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(POSITION))) for c in cols}
    carried = _carried(cut, last, lambda c, w: F.last(c, ignorenulls=True).over(w))
    w = Window.partitionBy(_SLICE).orderBy(POSITION).rowsBetween(Window.unboundedPreceding, 0)
    filled = cut.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols}).join(carried, _SLICE, "left")
    return filled.withColumns({c: F.coalesce(F.col(c), F.col(f"__{c}")) for c in cols}).select(*df.columns)


def running_whole(df: DataFrame, totals: dict[str, str], order: list[str], rows_per_slice: int = TARGET_ROWS) -> DataFrame:
    """Add running sums over all rows in ``order``: new name -> column; nulls count as nothing."""
    cut = _sliced(df, order, rows_per_slice)
    value = {k: F.coalesce(F.col(c), F.lit(0)) for k, c in totals.items()}
    carried = _carried(cut, {k: F.sum(x) for k, x in value.items()}, lambda c, w: F.sum(c).over(w))
    w = Window.partitionBy(_SLICE).orderBy(POSITION).rowsBetween(Window.unboundedPreceding, 0)
    summed = cut.withColumns({k: F.sum(x).over(w) for k, x in value.items()}).join(carried, _SLICE, "left")
    return summed.withColumns({k: F.col(k) + F.coalesce(F.col(f"__{k}"), F.lit(0)) for k in totals}).select(*df.columns, *totals)
