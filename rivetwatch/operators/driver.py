"""Which sensor explains an asset's risk: newest value against the rest of the fleet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import Keys, display_of, region_of, sensor_columns
from ..functions.scalars import normalize_risk
from .series import latest_per_asset


def leave_one_out_z(value: Column, n: Column, mean: Column, var_pop: Column) -> Column:
    """z of a value against its column without that value, in closed form.

    Removing one value ``v`` from n values changes the mean by ``(v-mean)/(n-1)``
    and the squared sum by ``(v-mean)^2 * n/(n-1)``.  Where the others have no
    spread, the score is the sign of the difference.
    """
    rest = n - 1
    gap = value - mean
    others = mean - gap / F.nullif(rest, F.lit(0))
    m2 = var_pop * n
    m2_rest = m2 - gap * gap * n / F.nullif(rest, F.lit(0))
    # Cancellation leaves rounding noise of relative size 1e-15; below 1e-12 the rest is flat.
    flat = (m2_rest <= m2 * 1e-12) | (m2_rest / F.nullif(rest, F.lit(0)) <= 1e-24)
    away = value - others
    sign = F.when(F.abs(away) <= 1e-12 * F.greatest(F.lit(1.0), F.abs(value)), 0.0).otherwise(F.signum(away))
    return F.when(rest < 1, 0.0).when(flat, sign).otherwise(away / F.sqrt(m2_rest / rest))


def sensor_drivers(
    df: DataFrame, predictions: DataFrame, sensors: list[str] | None = None, keys: Keys = Keys()
) -> DataFrame:
    """Top driver per predicted asset; only High and Medium assets name one.

    The fleet statistics are one row; the newest values one row per asset; the
    choice among sensors happens inside the row.
    """
    sensors = sensors or sensor_columns(df, keys)
    fleet = df.agg(
        *[
            F.struct(F.count(c).alias("n"), F.avg(c).alias("mean"), F.var_pop(c).alias("var")).alias(f"__{c}")
            for c in sensors
        ]
    )
    newest = latest_per_asset(df, sensors, keys)
    risk = normalize_risk(F.col("risk_level"))
    rows = (
        predictions.select(keys.id, risk.alias("risk"))
        .join(newest, keys.id, "left")
        .crossJoin(F.broadcast(fleet))
    )
    scored = []
    for i, c in enumerate(sensors):
        z = leave_one_out_z(F.col(c).cast("double"), F.col(f"__{c}.n"), F.col(f"__{c}.mean"), F.col(f"__{c}.var"))
        phrase, region = region_of(c)
        # |z| equal to nine digits resolves to the earlier column.
        scored.append(
            F.when(
                F.col(c).isNotNull(),
                F.struct(
                    F.round(F.abs(z), 9).alias("abs_z"), F.lit(-i).alias("order"), F.lit(c).alias("sensor"),
                    F.col(c).cast("double").alias("value"), z.alias("z"), F.lit(region).alias("region"),
                    F.lit(phrase).alias("region_label"), F.lit(f"{display_of(c)} → {phrase}").alias("text"),
                ),
            )
        )
    top = F.array_max(F.array(*scored))
    named = rows.select(keys.id, "risk", F.when(F.col("risk").isin("High", "Medium"), top).alias("top")).withColumn(
        "top", F.when(F.col("top.abs_z") > 1e-12, F.col("top"))
    )
    blank = F.lit("")
    return named.select(
        keys.id, "risk",
        F.coalesce("top.sensor", blank).alias("sensor"),
        F.col("top.value").alias("value"),
        F.coalesce("top.z", F.lit(0.0)).alias("z"),
        F.coalesce("top.region", blank).alias("region"),
        F.coalesce("top.region_label", blank).alias("region_label"),
        F.coalesce(F.concat(F.col("risk"), F.lit(" driven by "), F.col("top.text")), blank).alias("line"),
    )
