"""Standing questions over the fleet, as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import Keys


def most_urgent(ranked: DataFrame, keys: Keys = Keys()) -> DataFrame:
    """The rank-1 asset with its first three reasons."""
    return ranked.filter(F.col("rank") == 1).select(
        keys.id, "risk_level", "predicted_rul_days", F.array_join(F.slice("why", 1, 3), "; ").alias("why")
    )


def named_asset(ranked: DataFrame, question: str, keys: Keys = Keys()) -> DataFrame:
    """Assets whose id appears in the question text."""
    return ranked.filter(F.lit(question.lower()).contains(F.lower(F.col(keys.id)))).select(
        keys.id, "rank", "risk_level", "predicted_rul_days", F.array_join("why", "; ").alias("why")
    )


def slowest(slow: DataFrame) -> DataFrame:
    return slow.orderBy("gap_pct", "machine_id").limit(1)


def anomaly_count(scored: DataFrame) -> DataFrame:
    n, bad = F.count(F.lit(1)), F.count_if("is_anomaly")
    return scored.agg(bad.alias("flagged"), n.alias("rows"), F.round(100.0 * bad / n, 2).alias("rate_pct"))
