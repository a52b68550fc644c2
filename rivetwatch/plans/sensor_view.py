"""Sensor readings derived from the ``events`` table, in Spark and in SQL.

The given tables hold no sensors.  Both engines build the same view, so every
operator can be compared on identical input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.readers import spread_input

READINGS_SQL = """
  SELECT event_id,
         concat('M-', lpad(cast(user_id AS VARCHAR), 4, '0')) AS machine_id,
         ts AS "timestamp",
         CAST(40 + k AS DOUBLE) AS temperature,
         value / 25 AS vibration,
         100 - CAST(k AS DOUBLE) / 4 AS pressure,
         CAST(1500 + event_id % 100 AS DOUBLE) AS rpm,
         CAST(15 + k % 50 AS DOUBLE) AS oil_pressure,
         event_type,
         CAST(event_type = 'error' AS INTEGER) AS failure
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def readings(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """Clean sensor readings: one row per event; ``spread`` is for CPU-heavy work on few files."""
    k = F.col("__k")
    events = table(spark, sf_dir, "events")
    # A column of its own: three sensors come from it, and a text is parsed once a row.
    parsed = (spread_input(events) if spread else events).withColumn("__k", F.get_json_object("props", "$.k").cast("int"))
    return parsed.select(
        "event_id",
        F.concat(F.lit("M-"), F.lpad(F.col("user_id").cast("string"), 4, "0")).alias("machine_id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        (k + 40).cast("double").alias("temperature"),
        (F.col("value") / 25).alias("vibration"),
        (100 - k.cast("double") / 4).alias("pressure"),
        (1500 + F.col("event_id") % 100).cast("double").alias("rpm"),
        (15 + k % 50).cast("double").alias("oil_pressure"),
        "event_type",
        (F.col("event_type") == "error").cast("int").alias("failure"),
    )


def with_gaps(df: DataFrame, every: int = 17) -> DataFrame:
    """Missing cells by rule: core sensors are NULL where ``event_id % 17 = 0``."""
    gap = F.col("event_id") % every == 0
    return df.withColumns({c: F.when(~gap, F.col(c)) for c in ("temperature", "vibration", "pressure", "rpm")})


GAPS_SQL = """
  SELECT * REPLACE (
         CASE WHEN event_id % 17 <> 0 THEN temperature END AS temperature,
         CASE WHEN event_id % 17 <> 0 THEN vibration END AS vibration,
         CASE WHEN event_id % 17 <> 0 THEN pressure END AS pressure,
         CASE WHEN event_id % 17 <> 0 THEN rpm END AS rpm)
  FROM readings
"""


def with_life(df: DataFrame) -> DataFrame:
    """Add ``failure_within_days``: whole days from the row to its asset's last row."""
    micros = F.unix_micros("timestamp")
    last = df.groupBy("machine_id").agg(F.max(micros).alias("__last"))
    days = F.floor((F.col("__last") - micros) / F.lit(86_400_000_000)).cast("double")
    return df.join(last, "machine_id").withColumn("failure_within_days", days).drop("__last")


LIFE_SQL = """
  SELECT r.*, CAST(floor((l.last_us - epoch_us(r."timestamp")) / 86400000000) AS DOUBLE) AS failure_within_days
  FROM readings r JOIN (SELECT machine_id, max(epoch_us("timestamp")) AS last_us FROM readings GROUP BY 1) l
    USING (machine_id)
"""


def as_text(df: DataFrame) -> DataFrame:
    """The readings as an untyped file would give them: every cell text, some cells sentinels."""
    dirty = F.col("event_id") % 23
    cells = {
        "temperature": F.when(dirty == 0, "N/A").otherwise(F.col("temperature").cast("string")),
        "vibration": F.when(dirty == 1, "--").otherwise(F.col("vibration").cast("string")),
        "event_type": F.when(dirty == 2, "").otherwise(F.col("event_type")),
        "timestamp": F.when(dirty == 3, "not a time").otherwise(
            F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS")
        ),
        "pressure": F.col("pressure").cast("string"),
    }
    return df.select("event_id", "machine_id", *[e.alias(c) for c, e in cells.items()])


TEXT_SQL = """
  SELECT event_id, machine_id,
         CASE WHEN event_id % 23 = 0 THEN 'N/A' ELSE CAST(temperature AS VARCHAR) END AS temperature,
         CASE WHEN event_id % 23 = 1 THEN '--' ELSE CAST(vibration AS VARCHAR) END AS vibration,
         CASE WHEN event_id % 23 = 2 THEN '' ELSE event_type END AS event_type,
         CASE WHEN event_id % 23 = 3 THEN 'not a time'
              ELSE strftime("timestamp", '%Y-%m-%d %H:%M:%S.%f') END AS "timestamp",
         CAST(pressure AS VARCHAR) AS pressure
  FROM readings
"""


def maintenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work orders per asset, from ``orders``."""
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("M-"), F.lpad(F.col("o_custkey").cast("string"), 4, "0")).alias("machine_id"),
        F.col("o_orderkey").alias("work_order"),
        F.col("o_orderpriority").alias("maintenance_type"),
        (F.col("o_totalprice") / 10_000).alias("hours_downtime"),
        F.col("o_orderstatus").alias("event_type"),
    )


MAINTENANCE_SQL = """
  SELECT concat('M-', lpad(cast(o_custkey AS VARCHAR), 4, '0')) AS machine_id, o_orderkey AS work_order,
         o_orderpriority AS maintenance_type, o_totalprice / 10000 AS hours_downtime, o_orderstatus AS event_type
  FROM orders
"""


def costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost figures per asset, from ``customer``."""
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("M-"), F.lpad(F.col("c_custkey").cast("string"), 4, "0")).alias("machine_id"),
        F.col("c_acctbal").alias("downtime_cost"),
        F.col("c_mktsegment").alias("segment"),
    )


COSTS_SQL = """
  SELECT concat('M-', lpad(cast(c_custkey AS VARCHAR), 4, '0')) AS machine_id,
         c_acctbal AS downtime_cost, c_mktsegment AS segment
  FROM customer
"""


# ---------------------------------------------------------------- richer views
def engine(df: DataFrame) -> DataFrame:
    """Sensors of the aviation, automotive and oil-well packs, from the same readings."""
    k = F.col("temperature") - 40
    return df.withColumns(
        {
            "egt": 600 + 2 * k,
            "cht": 100 + k,
            "oil_temp": 60 + k / 2,
            "coolant_temp": 60 + k / 2,
            "engine_load": k,
            "pump_fillage": 50 + k / 2,
            "production_bbl": F.col("vibration") * 25,
            "polish_rod_load": 5000 + F.col("rpm"),
        }
    )


ENGINE_SQL = """
  SELECT *, 600 + 2 * (temperature - 40) AS egt, 100 + (temperature - 40) AS cht,
         60 + (temperature - 40) / 2 AS oil_temp, 60 + (temperature - 40) / 2 AS coolant_temp,
         temperature - 40 AS engine_load, 50 + (temperature - 40) / 2 AS pump_fillage,
         vibration * 25 AS production_bbl, 5000 + rpm AS polish_rod_load
  FROM readings
"""


def scored(df: DataFrame) -> DataFrame:
    """A score SQL can also compute: mean |z| of temperature and vibration.

    Stands in for the forest where an operator downstream of scoring is compared.
    """
    stats = df.agg(
        F.avg("temperature").alias("__tm"), F.stddev_samp("temperature").alias("__ts"),
        F.avg("vibration").alias("__vm"), F.stddev_samp("vibration").alias("__vs"),
    )
    z = (
        F.abs(F.col("temperature") - F.col("__tm")) / F.col("__ts") + F.abs(F.col("vibration") - F.col("__vm")) / F.col("__vs")
    ) / 2
    out = df.crossJoin(F.broadcast(stats)).withColumn("anomaly_score", F.round(z, 6))
    return out.withColumn("is_anomaly", F.col("anomaly_score") > 1.6).select(*df.columns, "anomaly_score", "is_anomaly")


SCORED_SQL = """
  SELECT *, anomaly_score > 1.6 AS is_anomaly FROM (
    SELECT r.*, round((abs(temperature - tm) / ts + abs(vibration - vm) / vs) / 2, 6) AS anomaly_score
    FROM readings r, (SELECT avg(temperature) AS tm, stddev_samp(temperature) AS ts,
                             avg(vibration) AS vm, stddev_samp(vibration) AS vs FROM readings))
"""

PREDICTIONS_SQL = """
  SELECT machine_id, days AS predicted_rul_days,
         CASE WHEN days <= 7 THEN 'High' WHEN days <= 14 THEN 'Medium' ELSE 'Low' END AS risk_level,
         true AS is_proxy, 'synthetic_degradation_proxy' AS label_source
  FROM (
    SELECT machine_id, CAST(greatest(1, round_even(arg_max(rul, ("timestamp", event_id)), 0)) AS INTEGER) AS days
    FROM (
      SELECT machine_id, "timestamp", event_id, least(greatest((1 - wear / (max(wear) OVER () + 1e-6)) * 30 + 1, 1), 30) AS rul
      FROM (SELECT r.machine_id, r."timestamp", r.event_id,
                   temperature / (mt + 1e-6) + vibration / (mv + 1e-6) + pressure / (mp + 1e-6) + rpm / (mr + 1e-6) AS wear
            FROM readings r, (SELECT max(temperature) AS mt, max(vibration) AS mv, max(pressure) AS mp, max(rpm) AS mr FROM readings)))
    GROUP BY machine_id)
"""

# (column, comparison, rule, label, fault) in rule order.
DEFAULT_RULES = (
    ("temperature", "> 120", "Temperature high", "Overheating / cooling", "Overheating"),
    ("oil_pressure", "< 20", "Oil pressure low", "Low oil", "Low oil"),
    ("vibration", "> 8", "Vibration high", "rotating assembly", "High vibration"),
)
AVIATION_RULES = (
    ("egt", "> 780", "EGT high", "Overheating", "Overheating"),
    ("cht", "> 195", "CHT high", "Overheating / cooling", "Overheating"),
    ("oil_pressure", "< 45", "Oil pressure low", "Low oil", "Low oil"),
    ("vibration", "> 5", "Vibration high", "rotating assembly", "High vibration"),
)


def redline_sql(source: str, rules) -> str:
    rule = ", ".join(f"CASE WHEN {c} {op} THEN '{r}' END" for c, op, r, _, _ in rules)
    label = ", ".join(f"CASE WHEN {c} {op} THEN '{t}' END" for c, op, _, t, _ in rules)

    def any_of(fault):
        return " OR ".join(f"coalesce({c} {op}, false)" for c, op, _, _, f in rules if f == fault) or "false"

    return f"""
      SELECT *, physics_fault <> 'None' AS physics_alert FROM (
        SELECT *, CASE WHEN {any_of('Low oil')} THEN 'Low oil' WHEN {any_of('Overheating')} THEN 'Overheating'
                       WHEN {any_of('High vibration')} THEN 'High vibration' ELSE 'None' END AS physics_fault,
               concat_ws('; ', {rule}) AS physics_rule,
               coalesce(nullif(concat_ws('; ', {label}), ''), 'None') AS physics_label
        FROM {source})
    """


def physics_summary_sql(source: str) -> str:
    newest = ", ".join(
        f'arg_max({c}, ("timestamp", event_id)) AS {c}' for c in ("physics_alert", "physics_fault", "physics_rule", "physics_label")
    )
    return f"""
      SELECT *, CASE physics_fault WHEN 'Low oil' THEN 'oil_system' WHEN 'Overheating' THEN 'heads_exhaust'
                     WHEN 'High vibration' THEN 'rotating_crank' ELSE '' END AS region
      FROM (SELECT machine_id, {newest}, count(*) FILTER (physics_alert) AS n_alert_rows FROM {source} GROUP BY machine_id)
    """


# (column, sign): +1 where high is bad, -1 where low is bad.
PLANT_SENSORS = (("vibration", 1), ("temperature", 1), ("pressure", -1), ("rpm", -1))
AVIATION_SENSORS = (("egt", 1), ("cht", 1), ("vibration", 1), ("oil_temp", 1), ("temperature", 1), ("oil_pressure", -1))
AUTO_SENSORS = (("coolant_temp", 1), ("vibration", 1), ("engine_load", 1), ("temperature", 1), ("oil_pressure", -1))
WELL_SENSORS = (("polish_rod_load", 1), ("vibration", 1), ("pump_fillage", -1), ("production_bbl", -1))
RISK_BASE_SQL = "CASE p.risk_level WHEN 'High' THEN 38.0::DOUBLE WHEN 'Medium' THEN 72.0::DOUBLE WHEN 'Low' THEN 92.0::DOUBLE ELSE 70.0::DOUBLE END"


def health_sql(source: str, sensors) -> str:
    points = " + ".join(
        f"""CASE WHEN count({c}) >= 3 THEN 4 * least(greatest({sign} *
            (arg_max({c}, ("timestamp", event_id)) FILTER ({c} IS NOT NULL) - avg({c})) / (stddev_samp({c}) + 1e-9), 0), 3)
            ELSE 0 END"""
        for c, sign in sensors
    )
    return f"""
      SELECT machine_id, risk_level, predicted_rul_days, health_index,
             CASE WHEN predicted_rul_days >= 0 THEN round_even(predicted_rul_days * 24.0::DOUBLE * 0.35::DOUBLE, 1) ELSE 0 END AS remaining_mission_hours,
             CAST(least(greatest(round_even(health_index, 0), 0), 100) AS INTEGER) AS mission_success_pct
      FROM (
        SELECT s.machine_id, coalesce(p.risk_level, 'Unknown') AS risk_level, p.predicted_rul_days,
               least(greatest(round_even({RISK_BASE_SQL}
                 - CASE WHEN p.predicted_rul_days <= 7 THEN 8 WHEN p.predicted_rul_days <= 14 THEN 3 ELSE 0 END
                 - least(s.pts, 28), 1), 0), 100) AS health_index
        FROM (SELECT machine_id, {points} AS pts FROM {source} GROUP BY machine_id) s
        LEFT JOIN preds p USING (machine_id))
    """


# Reason sensors in column order, as the readings have them.
_WHY = ("temperature", "vibration", "pressure", "rpm", "oil_pressure", "failure")


def _why_sql() -> str:
    parts = [
        "'mean outlier score ' || CAST(mean_anomaly_score AS VARCHAR)",
        "CASE WHEN anomaly_count > 0 THEN CAST(anomaly_count AS VARCHAR) || ' outlying rows, ' || CAST(anomaly_rate_pct AS VARCHAR) || '% of all' END",
        "'days left by wear ' || CAST(predicted_rul_days AS VARCHAR)",
    ]
    for c in _WHY:
        gap = f"(l_{c} - m_{c}) / nullif(abs(m_{c}), 0) * 100"
        parts.append(
            f"CASE WHEN abs({gap}) >= 12 THEN '{c} ' || CASE WHEN {gap} > 0 THEN 'up' ELSE 'down' END || ' at ' || "
            f"printf('%.2f', l_{c}) || ', median ' || printf('%.2f', m_{c}) || ', ' || "
            f"printf('%+.0f', {gap}) || '%' END"
        )
    return f"list_slice(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL), 1, 6)"


_MOVED = "coalesce(" + " OR ".join(f"abs((l_{c} - m_{c}) / nullif(abs(m_{c}), 0) * 100) >= 12" for c in _WHY) + ", false)"

RANKED_SQL = f"""
  SELECT *, CAST(row_number() OVER (ORDER BY CASE risk_level WHEN 'High' THEN 0 WHEN 'Medium' THEN 1 WHEN 'Low' THEN 2 ELSE 3 END,
            predicted_rul_days NULLS LAST, mean_anomaly_score DESC, machine_id) AS INTEGER) AS rank
  FROM (
    SELECT *, {_why_sql()} AS why, {_MOVED} AS moved FROM (
      SELECT s.*, p.predicted_rul_days, coalesce(p.risk_level, 'Unknown') AS risk_level,
             {', '.join(f'm.m_{c}' for c in _WHY)}
      FROM (SELECT machine_id, count(*) AS n_rows, round_even(avg(anomaly_score), 4) AS mean_anomaly_score,
                   round_even(max(anomaly_score), 4) AS max_anomaly_score, count(*) FILTER (is_anomaly) AS anomaly_count,
                   round_even(100.0::DOUBLE * count(*) FILTER (is_anomaly) / count(*), 2) AS anomaly_rate_pct,
                   {', '.join(f'CAST(arg_max({c}, ("timestamp", event_id)) AS DOUBLE) AS l_{c}' for c in _WHY)}
            FROM scored GROUP BY machine_id) s
      LEFT JOIN preds p USING (machine_id),
           (SELECT {', '.join(f'CAST(quantile_cont({c}, 0.5) AS DOUBLE) AS m_{c}' for c in _WHY)} FROM scored) m))
"""

_DRIVER_SENSORS = ("temperature", "vibration", "pressure", "rpm", "oil_pressure", "failure")
_REGION = {
    "temperature": ("heads_exhaust", "heads / exhaust", "temperature (temp)"),
    "vibration": ("rotating_crank", "rotating assembly", "vibration"),
    "pressure": ("other", "other / unmapped region", "pressure"),
    "rpm": ("rotating_crank", "crank / prop", "rpm"),
    "oil_pressure": ("oil_system", "oil system", "oil_pressure"),
    "failure": ("other", "other / unmapped region", "failure"),
}


def _driver_z(c: str) -> str:
    return (
        f"(v_{c} - (mu_{c} - (v_{c} - mu_{c}) / (n - 1))) / "
        f"sqrt((var_{c} * n - (v_{c} - mu_{c}) * (v_{c} - mu_{c}) * n / (n - 1)) / (n - 1))"
    )


def _case(column: str, index: int) -> str:
    return "CASE " + column + " " + " ".join(f"WHEN '{c}' THEN '{_REGION[c][index]}'" for c in _DRIVER_SENSORS) + " END"


DRIVERS_SQL = f"""
  SELECT machine_id, risk_level AS risk, CASE WHEN named THEN sensor ELSE '' END AS sensor,
         CASE WHEN named THEN val END AS value, CASE WHEN named THEN z ELSE 0 END AS z,
         CASE WHEN named THEN {_case('sensor', 0)} ELSE '' END AS region,
         CASE WHEN named THEN {_case('sensor', 1)} ELSE '' END AS region_label,
         CASE WHEN named THEN risk_level || ' driven by ' || {_case('sensor', 2)} || ' → ' || {_case('sensor', 1)} ELSE '' END AS line
  FROM (
    SELECT machine_id, risk_level, risk_level IN ('High', 'Medium') AS named, sensor, val, z,
           row_number() OVER (PARTITION BY machine_id ORDER BY round(abs(z), 9) DESC, pos) AS rn
    FROM (
      SELECT p.machine_id, p.risk_level, u.pos, u.sensor, u.val, u.z
      FROM preds p JOIN (
        SELECT machine_id, unnest([{', '.join(str(i) for i in range(len(_DRIVER_SENSORS)))}]) AS pos,
               unnest([{', '.join(f"'{c}'" for c in _DRIVER_SENSORS)}]) AS sensor,
               unnest([{', '.join(f'CAST(v_{c} AS DOUBLE)' for c in _DRIVER_SENSORS)}]) AS val,
               unnest([{', '.join(_driver_z(c) for c in _DRIVER_SENSORS)}]) AS z
        FROM (SELECT machine_id, {', '.join(f'arg_max({c}, ("timestamp", event_id)) AS v_{c}' for c in _DRIVER_SENSORS)}
              FROM readings GROUP BY machine_id),
             (SELECT count(*) AS n, {', '.join(f'avg({c}) AS mu_{c}, var_pop({c}) AS var_{c}' for c in _DRIVER_SENSORS)} FROM readings)
      ) u USING (machine_id)))
  WHERE rn = 1
"""


def advisory_sql(risk: str, fault: str, sensor: str, region: str, phrase: str) -> str:
    blob = f"lower({fault} || ' ' || {sensor} || ' ' || {region})"
    urgent = f"({risk} = 'High' OR {fault} <> 'None')"

    def has(*tokens):
        return "(" + " OR ".join(f"contains({blob}, '{t}')" for t in tokens) + ")"

    return f"""CASE
      WHEN {urgent} AND ({fault} = 'Low oil' OR {has('oil')}) THEN 'Inspect oil'
      WHEN {urgent} AND ({fault} = 'Overheating' OR {has('egt', 'cht', 'exhaust', 'head', 'cool', 'temp')}) THEN 'Check cooling'
      WHEN {urgent} AND ({fault} = 'High vibration' OR {has('vib', 'rotat', 'crank')}) THEN 'Inspect rotating assembly'
      WHEN {risk} = 'High' THEN CASE WHEN {phrase} <> '' THEN 'Inspect ' || {phrase} ELSE 'Inspect' END
      WHEN {risk} = 'Medium' THEN CASE WHEN {phrase} <> '' THEN 'Monitor / inspect ' || {phrase} ELSE 'Monitor' END
      ELSE 'OK' END"""


ITEMS_SQL = f"""
  SELECT machine_id, {advisory_sql('risk_level', 'physics_fault', 'sensor', 'region', 'phrase')} AS action,
         physics_fault, physics_rule, physics_label, risk_level, health_index, mission_success_pct,
         'If ' || machine_id || ' flies next mission, ' || CAST(mission_success_pct AS VARCHAR) || '% success chance' AS mission_line
  FROM (
    SELECT *, CASE WHEN given IN ('', 'other / unmapped region') AND given <> '' THEN ''
                   WHEN given <> '' THEN given
                   ELSE CASE region WHEN 'oil_system' THEN 'oil' WHEN 'heads_exhaust' THEN 'cooling'
                        WHEN 'rotating_crank' THEN 'rotating assembly' ELSE '' END END AS phrase
    FROM (
      SELECT h.machine_id, p.risk_level, f.physics_fault, f.physics_rule, f.physics_label, h.health_index, h.mission_success_pct,
             d.sensor, coalesce(nullif(d.region, ''), f.region) AS region, d.region_label AS given
      FROM health h JOIN preds p USING (machine_id) JOIN physics f USING (machine_id) JOIN drivers d USING (machine_id)))
"""

GO_SQL = """CASE WHEN action = 'OK' THEN CASE WHEN risk_level = 'High' THEN 'NO-GO' ELSE 'GO' END
                 WHEN lower(action) LIKE 'inspect%' OR lower(action) LIKE 'check%' THEN 'NO-GO'
                 WHEN lower(action) LIKE 'monitor%' THEN 'CAUTION' ELSE 'GO' END"""
CODE_SQL = """CASE WHEN action = 'OK' THEN '' WHEN action = 'Inspect oil' THEN 'OIL' WHEN action = 'Check cooling' THEN 'COOL'
                   WHEN action = 'Inspect rotating assembly' THEN 'VIB' WHEN lower(action) LIKE 'monitor%' THEN 'MON' ELSE 'INSP' END"""

ASSETS_SQL = f"""
  SELECT machine_id, 'plant_rotating' AS pack_id, 'Plant' AS pack, strftime(last_ts, '%Y-%m-%dT%H:%M:%S.%f') AS last_timestamp,
         risk_level, health_index, mission_success_pct, action AS advisory, {GO_SQL} AS go_nogo,
         CASE WHEN code <> '' THEN 'WO-' || machine_id || '-' || code ELSE '' END AS work_order_id,
         CASE WHEN code <> '' THEN action ELSE '' END AS wo_title, CASE WHEN code <> '' THEN 'open' ELSE '' END AS wo_status,
         physics_fault
  FROM (SELECT i.*, {CODE_SQL} AS code, l.last_ts FROM items i
        JOIN (SELECT machine_id, max("timestamp") AS last_ts FROM readings GROUP BY 1) l USING (machine_id))
"""


def throughput(df: DataFrame) -> DataFrame:
    """A production figure per reading that differs between assets."""
    asset = F.substring("machine_id", 3, 4).cast("int")
    return df.withColumn("throughput", F.col("temperature") + (asset % 5) * 4.0)


THROUGHPUT_SQL = """
  SELECT *, temperature + (CAST(substr(machine_id, 3, 4) AS INTEGER) % 5) * 4.0::DOUBLE AS throughput FROM readings
"""

SLOW_SQL = """
  SELECT machine_id, 'Below pace: ' || machine_id AS title, 'Medium' AS severity, 'throughput' AS "column", mean, fleet_median, gap_pct,
         machine_id || ' falls short in throughput: mean ' || printf('%.2f', mean) || ', median of the fleet ' ||
         printf('%.2f', fleet_median) || ', ' || printf('%.0f', gap_pct) || '%.' AS message
  FROM (SELECT machine_id, mean, fleet_median, (mean - fleet_median) / abs(fleet_median) * 100 AS gap_pct
        FROM (SELECT machine_id, avg(throughput) AS mean FROM throughput GROUP BY 1),
             (SELECT quantile_cont(throughput, 0.5) AS fleet_median FROM throughput))
  WHERE gap_pct <= -8
"""
