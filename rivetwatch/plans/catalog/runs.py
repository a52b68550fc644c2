"""Whole batch runs: cleaning with its report, and the run from readings to advice."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sensor_view as v
from ..pipeline import clean_and_quality, run_reliability
from .quality import SQL_STAGES
from .registry import query, sql

_CORE = ("temperature", "vibration", "pressure", "rpm")

# Forward fill per asset, the table's median, then values capped at the quartiles' reach; as views over ``filled``.
_MEDIANS = ", ".join(f"coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM filled)) AS {c}" for c in _CORE)
_REACH = ", ".join(f"quantile_cont({c}, 0.25) AS a_{c}, quantile_cont({c}, 0.75) AS b_{c}" for c in _CORE)
_CAPPED = ", ".join(f"least(greatest({c}, a_{c} - 1.5 * (b_{c} - a_{c})), b_{c} + 1.5 * (b_{c} - a_{c})) AS {c}" for c in _CORE)
_BOUNDS = ", ".join(f"a_{c}, b_{c}" for c in _CORE)
CLEANED = {
    "complete": f"SELECT * REPLACE ({_MEDIANS}) FROM filled",
    "cleaned": f"SELECT * EXCLUDE ({_BOUNDS}) REPLACE ({_CAPPED}) FROM complete, (SELECT {_REACH} FROM complete)",
}


# A stage's SQL reads ``gaps``: inside its own WITH the name stands for the cleaned table.
@query("clean_and_quality", sql("filled", " UNION ALL ".join(
    f"SELECT * FROM (WITH gaps AS (SELECT * FROM cleaned) {body})" for body in SQL_STAGES.values()), **CLEANED))
def cleaned_report(spark, d):
    return clean_and_quality(v.with_gaps(v.readings(spark, d)), checks=list(SQL_STAGES))[1]


# What the fitted models say has no SQL; that every asset gets an advice, a risk and a life within the limits has.
@query("reliability_run", sql("filled", """
  SELECT machine_id, 'plant_rotating' AS pack_id, n_rows, last_timestamp, physics_fault, physics_rule, n_alert_rows,
         true AS scored, true AS predicted, true AS advised
  FROM fired JOIN (SELECT machine_id, count(*) AS n_rows, strftime(max("timestamp"), '%Y-%m-%dT%H:%M:%S.%f') AS last_timestamp
                   FROM cleaned GROUP BY 1) USING (machine_id)""",
    **CLEANED, fired_rows=v.redline_sql("cleaned", v.DEFAULT_RULES), fired=v.physics_summary_sql("fired_rows")))
def reliability_run(spark, d):
    run = run_reliability(v.with_gaps(v.readings(spark, d)), rul_trees=20)
    rows = run.scored.groupBy("machine_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.every(F.col("anomaly_score").between(0, 1)).alias("scored"))
    fired = run.bundle.physics.select("machine_id", "physics_rule", "n_alert_rows")
    lives = run.predictions.select("machine_id", F.col("predicted_rul_days").between(0, 30).alias("predicted"))
    out = run.assets.join(rows, "machine_id").join(fired, "machine_id").join(lives, "machine_id")
    return out.select(
        "machine_id", "pack_id", "n_rows", "last_timestamp", "physics_fault", "physics_rule", "n_alert_rows", "scored", "predicted",
        (F.col("advisory") != "").alias("advised"))
