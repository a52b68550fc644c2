"""Exact linear-interpolated quantiles that never gather a large group.

``percentile`` keeps one value->count map per group in one task.  That is fine
up to a checked group size and is used there.  Beyond it the wanted ranks are
bracketed by a sketch first, and only the rows inside the brackets (some
0.06 % of them, or copies of a few values) are counted by value.  The result
is the same exact number.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

# Largest group that may be handled by one ``percentile`` map.
MAX_GROUP_ROWS = 2_000_000
_ACCURACY = 10_000


def quantiles(
    df: DataFrame,
    cols: list[str],
    probs: list[float],
    by: list[str] | None = None,
    group_rows: int | None = None,
    method: str | None = None,
) -> DataFrame:
    """One row per group: the ``by`` columns plus, per column, an array of quantiles.

    ``group_rows`` is the size of the largest group if the caller knows it.
    """
    by = by or []
    if method is None:
        if group_rows is None:
            group_rows = largest_group(df, by)
        method = "direct" if group_rows <= MAX_GROUP_ROWS else "bracket"
    if method == "direct":
        wanted = F.array(*[F.lit(float(p)) for p in probs])
        return df.groupBy(*by).agg(*[F.percentile(F.col(c), wanted).alias(c) for c in cols])
    return _bracketed(df, cols, probs, by)


def largest_group(df: DataFrame, by: list[str]) -> int:
    sizes = df.groupBy(*by).count() if by else df.agg(F.count(F.lit(1)).alias("count"))
    return sizes.agg(F.max("count")).first()[0] or 0


def _bracketed(df: DataFrame, cols: list[str], probs: list[float], by: list[str]) -> DataFrame:
    """Two passes over ``df``: a sketch brackets each wanted rank, then one aggregate counts what lies in the brackets."""
    margin = 2.0 / _ACCURACY
    edges = sorted({e for p in probs for e in (max(p - margin, 0.0), min(p + margin, 1.0))})
    at = {e: i for i, e in enumerate(edges)}
    sketch = F.array(*[F.lit(e) for e in edges])

    bounds = df.groupBy(*by).agg(
        *[
            F.struct(
                F.count(c).alias("n"),
                F.min(c).alias("lo"),
                F.max(c).alias("hi"),
                F.approx_percentile(F.col(c), sketch, F.lit(_ACCURACY)).alias("e"),
            ).alias(c)
            for c in cols
        ]
    )
    wanted = [(c, p) for c in cols for p in probs]
    brackets = bounds.select(
        *by,
        *[_edge(c, "lo", None if p <= margin else at[max(p - margin, 0.0)]).alias(f"__lo{i}") for i, (c, p) in enumerate(wanted)],
        *[_edge(c, "hi", None if p >= 1 - margin else at[min(p + margin, 1.0)]).alias(f"__hi{i}") for i, (c, p) in enumerate(wanted)],
    )
    if by:
        return _pick(_counted(df, cols, wanted, brackets, by), cols, probs, wanted, by)
    ends = brackets.first()
    reach = [(cols.index(c), ends[f"__lo{i}"], ends[f"__hi{i}"]) for i, (c, _) in enumerate(wanted)]
    picked = _pick(_counted_whole(df, cols, reach), cols, probs, wanted, by)
    # One row, looked up by every later pass: without this each of them would run both passes again.
    return df.sparkSession.createDataFrame([picked.first()], picked.schema)


def _edge(c: str, side: str, index: int | None):
    """Bracket end: the sketch's edge, or min/max near the ends and for groups too small for its margin."""
    outer = F.col(c)[side].cast("double")
    if index is None:
        return outer
    return F.when(F.col(c)["n"] < 2 * _ACCURACY, outer).otherwise(F.col(c)["e"][index].cast("double"))


def _counted_whole(df: DataFrame, cols, reach: list[tuple[int, float | None, float | None]]) -> DataFrame:
    """What ``_counted`` gives, of a whole table: each batch of rows sends the values inside the brackets and its counts."""

    def count(batches):
        for batch in batches:
            values = [column.drop_null().to_numpy(zero_copy_only=False) for column in batch.columns]
            i, v, n, known = [], [], [], []
            for at, (j, lo, hi) in enumerate(reach):
                x = values[j]
                if lo is None or not len(x):
                    continue
                # As Spark orders them: NaN lies above all numbers and equals itself.
                below = ~np.isnan(x) if math.isnan(lo) else x < lo
                inside, times = np.unique(x[~below & ((x <= hi) | math.isnan(hi))], return_counts=True)
                i.append(np.full(len(inside) + 1, at, dtype="int32"))
                v.append(pa.array(np.append(inside, 0.0), mask=np.arange(len(inside) + 1) == len(inside)))
                n.append(np.append(times, below.sum()).astype("int64"))
                known.append(np.append(np.zeros(len(inside), dtype="int64"), len(x)))
            if i:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(i)), pa.concat_arrays(v), pa.array(np.concatenate(n)), pa.array(np.concatenate(known))],
                    names=["i", "v", "n", "known"],
                )

    rows = df.select(*[F.col(c).cast("double").alias(f"__v{j}") for j, c in enumerate(cols)])
    counts = rows.mapInArrow(count, "i int, v double, n long, known long")
    return counts.groupBy("i", "v").agg(F.sum("n").alias("n"), F.sum("known").alias("known"))


def _against(df: DataFrame, cols, brackets: DataFrame, by):
    """Rows, their columns as ``__v0``, ``__v1``, .., next to their group's brackets.

    The join is on the group key alone; rows of a hot group are spread by a salt.
    """
    rows = df.select(*by, *[F.col(c).cast("double").alias(f"__v{j}") for j, c in enumerate(cols)])
    salts = 64
    spread = brackets.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*[f"__v{j}" for j in range(len(cols))]), F.lit(salts)).cast("int"))
    return salted.join(spread, [*by, "__salt"]).drop("__salt")


def _counted(df, cols, wanted, brackets, by):
    """(group, i, v, n, known) of the i-th wanted quantile: values of its bracket with their numbers of rows.

    The line with NULL for ``v`` holds the number of rows below the bracket and of known values.  A row outside all
    brackets, as most are, costs its comparisons only; nothing is made or moved for it.
    """
    value = {c: F.col(f"__v{j}") for j, c in enumerate(cols)}
    hits = [value[c].between(F.col(f"__lo{i}"), F.col(f"__hi{i}")) for i, (c, _) in enumerate(wanted)]
    none = F.lit(None).cast("struct<i:int,v:double>")
    made = [F.when(hit, F.struct(F.lit(i).alias("i"), value[c].alias("v"))) for i, (hit, (c, _)) in enumerate(zip(hits, wanted))]
    some = reduce(Column.__or__, [F.coalesce(hit, F.lit(False)) for hit in hits])
    # Place 0 stands for the row itself, the others for its brackets.
    cells = F.when(some, F.array(none, *made)).otherwise(F.array(none))
    tagged = _against(df, cols, brackets, by).select(
        *by, *[value[c].isNotNull().alias(f"__known{j}") for j, c in enumerate(cols)],
        *[(value[c] < F.col(f"__lo{i}")).alias(f"__below{i}") for i, (c, _) in enumerate(wanted)],
        F.posexplode(cells).alias("__at", "__x"),
    ).filter((F.col("__at") == 0) | F.col("__x").isNotNull())
    itself = F.col("__at") == 0
    grouped = tagged.groupBy(*by, F.col("__x.i").alias("i"), F.col("__x.v").alias("v")).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(itself & F.col(f"__known{j}")).alias(f"__known{j}") for j in range(len(cols))],
        *[F.count_if(itself & F.col(f"__below{i}")).alias(f"__below{i}") for i in range(len(wanted))],
    )
    line = F.struct(F.col("i"), F.col("v"), F.col("n"), F.lit(0).cast("long").alias("known"))
    lines = [F.when(F.col("i").isNotNull(), line)]
    for i, (c, _) in enumerate(wanted):
        known = F.col(f"__known{cols.index(c)}")
        lines.append(F.when(known > 0, F.struct(
            F.lit(i).alias("i"), F.lit(None).cast("double").alias("v"), F.col(f"__below{i}").alias("n"), known.alias("known"))))
    long = grouped.select(*by, F.explode(F.array_compact(F.array(*lines))).alias("__l")).select(*by, "__l.*")
    return long.groupBy(*by, "i", "v").agg(F.sum("n").alias("n"), F.sum("known").alias("known"))


def _pick(counts: DataFrame, cols, probs, wanted, by):
    """The values at the wanted ranks, interpolated; back to one array per column."""
    each = Window.partitionBy(*by, "i")
    chance = F.element_at(F.array(*[F.lit(float(p)) for _, p in wanted]), F.col("i") + 1)
    upto = counts.withColumns({
        "upto": F.sum("n").over(each.orderBy(F.col("v").asc_nulls_first())), "rank": chance * (F.sum("known").over(each) - 1),
    }).filter(F.col("v").isNotNull())
    low = F.min(F.when(F.col("upto") > F.floor("rank"), F.col("v")))
    high = F.min(F.when(F.col("upto") > F.ceil("rank"), F.col("v")))
    share = F.col("rank") - F.floor("rank")
    picked = upto.groupBy(*by, "i", "rank").agg(low.alias("a"), high.alias("b"))
    picked = picked.select(*by, "i", (F.col("a") + (F.col("b") - F.col("a")) * share).alias("q"))

    def cell(c, p):
        return F.max(F.when(F.col("i") == wanted.index((c, p)), F.col("q")))

    return picked.groupBy(*by).agg(*[F.array(*[cell(c, p) for p in probs]).alias(c) for c in cols])
