"""One query per quality stage, and the whole report."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import quality
from .. import sensor_view as v
from .registry import query, sql

NUMBERS = ("temperature", "vibration", "pressure", "rpm", "oil_pressure", "failure")
COLUMNS = ("machine_id", "timestamp", *NUMBERS, "event_type")
_SERIES = 'PARTITION BY machine_id ORDER BY "timestamp", event_id'


def _table(spark, d):
    """Readings with missing cells; the shape every stage runs on."""
    return v.with_gaps(v.readings(spark, d))


def _stage(name):
    def run(spark, d):
        return quality.run_stages(_table(spark, d), [name])

    return run


# SQL of the stages that are plain statistics over ``gaps``, for other tables of that shape.
SQL_STAGES: dict[str, str] = {}


def _statistic(name, check, body):
    SQL_STAGES[check] = body
    query(name, sql("gaps", body))(_stage(check))


def _line(check, status, metric, detail, source):
    return f"SELECT '{check}' AS \"check\", {status} AS status, CAST({metric} AS DOUBLE) AS metric, {detail} AS detail FROM ({source})"


_HITS = "CAST(n AS VARCHAR) || ' hits'"
_WARN = "CASE WHEN n > 0 THEN 'WARN' ELSE 'PASS' END"

_missing = " + ".join(f'count(*) FILTER ("{c}" IS NULL)' for c in COLUMNS)
_statistic("q_nulls", "NULLS", _line(
    "NULLS", "CASE WHEN s > 0.2 THEN 'FAIL' WHEN s > 0.05 THEN 'WARN' ELSE 'PASS' END", "round(s, 6)",
    "printf('%.2f', s * 100) || '% missing'", f"SELECT ({_missing}) / (count(*) * {len(COLUMNS)}::DOUBLE) AS s FROM gaps",
))

_statistic("q_constant", "CONSTANT", _line(
    "CONSTANT", "CASE WHEN n > 0 THEN 'FAIL' ELSE 'PASS' END", "n", "CASE WHEN n > 0 THEN names ELSE 'none' END",
    "SELECT len(l) AS n, array_to_string(l, ', ') AS names FROM (SELECT list_filter(["
    + ", ".join(f"CASE WHEN count(DISTINCT \"{c}\") <= 1 THEN '{c}' END" for c in COLUMNS)
    + "], lambda x: x IS NOT NULL) AS l FROM gaps)",
))

_zero = " + ".join(f"count(*) FILTER ({c} = 0)" for c in NUMBERS)
_statistic("q_zeros", "ZEROS", _line(
    "ZEROS", "CASE WHEN s > 0.3 THEN 'WARN' ELSE 'PASS' END", "round(s, 6)", "printf('%.1f', s * 100) || '% zeros'",
    f"SELECT ({_zero}) / (count(*) * {len(NUMBERS)}::DOUBLE) AS s FROM gaps",
))

_z = " + ".join(f"count(*) FILTER (abs({c} - m_{c}) / (s_{c} + 1e-9) > 3)" for c in NUMBERS)
_zs = ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in NUMBERS)
_statistic("q_zscore", "Z-SCORE", _line("Z-SCORE", _WARN, "n", _HITS, f"SELECT {_z} AS n FROM gaps, (SELECT {_zs} FROM gaps)"))

_o = " + ".join(f"count(*) FILTER (b_{c} <> a_{c} AND ({c} < a_{c} - 1.5 * (b_{c} - a_{c}) OR {c} > b_{c} + 1.5 * (b_{c} - a_{c})))" for c in NUMBERS)
_os = ", ".join(f"CAST(quantile_cont({c}, 0.25) AS DOUBLE) AS a_{c}, CAST(quantile_cont({c}, 0.75) AS DOUBLE) AS b_{c}" for c in NUMBERS)
_statistic("q_iqr", "IQR", _line("IQR", _WARN, "n", _HITS, f"SELECT {_o} AS n FROM gaps, (SELECT {_os} FROM gaps)"))

_JUMPING = (("temperature", "50"), ("vibration", "5"), ("pressure", "30"), ("rpm", "4 * (SELECT stddev_samp(rpm) FROM gaps)"), ("oil_pressure", "30"))
_steps = ", ".join(f"{c} - lag({c}) OVER ({_SERIES}) AS d_{c}" for c, _ in _JUMPING)
_counts = ", ".join(f"count(*) FILTER (abs(d_{c}) > {limit}) AS j_{c}" for c, limit in _JUMPING)
_listed = "array_to_string(list_filter([" + ", ".join(
    f"CASE WHEN j_{c} > 0 THEN '{c}:' || CAST(j_{c} AS VARCHAR) END" for c, _ in _JUMPING) + "], lambda x: x IS NOT NULL), ', ')"
_statistic("q_jump", "IMPOSSIBLE JUMP", _line(
    "IMPOSSIBLE JUMP", "CASE WHEN n > 0 THEN 'FAIL' ELSE 'PASS' END", "n", "CASE WHEN n > 0 THEN t ELSE 'none' END",
    f"SELECT {' + '.join(f'j_{c}' for c, _ in _JUMPING)} AS n, {_listed} AS t FROM (SELECT {_counts} FROM (SELECT *, {_steps} FROM gaps))",
))

_pairs = (("temperature", "pressure"), ("temperature", "vibration"), ("pressure", "vibration"))
_statistic("q_correlation", "SENSOR CORRELATION", _line(
    "SENSOR CORRELATION", _WARN, "n", "CASE WHEN n > 0 THEN t ELSE 'none' END",
    "SELECT len(l) AS n, array_to_string(l, ', ') AS t FROM (SELECT list_filter(["
    + ", ".join(f"CASE WHEN abs(round(corr({a}, {b}), 3)) < 0.05 THEN '{a}|{b}' END" for a, b in _pairs)
    + "], lambda x: x IS NOT NULL) AS l FROM gaps)",
))

_statistic("q_labels", "DIRTY LABELS", _line(
    "DIRTY LABELS", _WARN, "n",
    "concat_ws('; ', CASE WHEN a > 0 THEN CAST(a AS VARCHAR) || ' failures on calm rows' END, "
    "CASE WHEN b > 0 THEN CAST(b AS VARCHAR) || ' rows without failure shake hard' END)",
    """SELECT a, b, a + b AS n FROM (SELECT count(*) FILTER (failure = 1 AND vibration < q20) AS a, count(*) FILTER (failure = 0 AND vibration > q95) AS b
       FROM gaps, (SELECT quantile_cont(vibration, 0.2) AS q20, quantile_cont(vibration, 0.95) AS q95 FROM gaps))""",
))


@query("q_domain", sql("gaps life", _line(
    "DOMAIN RULES", "CASE WHEN n > 0 THEN 'FAIL' ELSE 'PASS' END", "n",
    "CASE WHEN n > 0 THEN array_to_string(l, '; ') ELSE 'all rules hold' END",
    f"""SELECT len(l) AS n, l FROM (SELECT list_filter([
      CASE WHEN stuck > 0 THEN CAST(stuck AS VARCHAR) || ' hot rows without vibration' END,
      CASE WHEN leak > 0 THEN CAST(leak AS VARCHAR) || ' pressure drops at steady speed' END,
      CASE WHEN up > 0.6 THEN 'remaining life mostly grows' END,
      CASE WHEN missed > 0 THEN CAST(missed AS VARCHAR) || ' rows far above usual vibration and no failure' END
      ], lambda x: x IS NOT NULL) AS l
      FROM (SELECT count(*) FILTER (temperature > 150 AND vibration < 0.1) AS stuck, count(*) FILTER (dp < -10 AND abs(dr) < 0.5) AS leak,
                   avg(CASE WHEN dl > 0 THEN 1.0 ELSE 0.0 END) FILTER (dl IS NOT NULL) AS up,
                   count(*) FILTER (failure = 0 AND vibration > m + 3 * s) AS missed
            FROM (SELECT g.*, pressure - lag(pressure) OVER ({_SERIES}) AS dp, rpm - lag(rpm) OVER ({_SERIES}) AS dr,
                         failure_within_days - lag(failure_within_days) OVER ({_SERIES}) AS dl
                  FROM gaps g JOIN (SELECT event_id, failure_within_days FROM life) USING (event_id)),
                 (SELECT avg(vibration) AS m, stddev_samp(vibration) AS s FROM gaps)))""",
)))
def q_domain(spark, d):
    return quality.run_stages(v.with_life(_table(spark, d)), ["DOMAIN RULES"])


_statistic("q_rowcount", "SCHEMA / ROWCOUNT", _line(
    "SCHEMA / ROWCOUNT", "CASE WHEN n > 0 THEN 'PASS' ELSE 'FAIL' END", "n", f"CAST(n AS VARCHAR) || ' rows × {len(COLUMNS)} cols'",
    "SELECT count(*) AS n FROM gaps",
))

_statistic("q_timestamp", "TIMESTAMP PRESENT", _line("TIMESTAMP PRESENT", "'PASS'", "least(n, 1)", "'timestamp'", "SELECT count(*) AS n FROM gaps"))


@query("q_duplicates", sql("gaps", _line(
    "DUPLICATES", _WARN, "n", "CAST(n AS VARCHAR) || ' dup rows'",
    "SELECT CAST(sum(c - 1) AS BIGINT) AS n FROM (SELECT count(*) AS c FROM gaps GROUP BY machine_id, temperature, event_type)",
)))
def q_duplicates(spark, d):
    return quality.duplicates_stage(_table(spark, d).select("machine_id", "temperature", "event_type"))


_null_ok = " + ".join(f'CASE WHEN avg(CASE WHEN "{c}" IS NULL THEN 1.0 ELSE 0.0 END) < 0.2 THEN 1 ELSE 0 END' for c in COLUMNS)


@query("q_expectations", sql("gaps life", _line(
    "EXPECTATIONS", f"CASE WHEN n = {len(COLUMNS) + 5} THEN 'PASS' ELSE 'WARN' END", "n", f"CAST(n AS VARCHAR) || '/{len(COLUMNS) + 5} passed'",
    f"""SELECT CAST(a + b + c + e + f AS BIGINT) AS n FROM
      (SELECT {_null_ok} + 1 AS a, CASE WHEN min(temperature) >= 0 AND max(temperature) <= 200 THEN 1 ELSE 0 END AS b,
              CASE WHEN count(*) BETWEEN 1 AND 5000000 THEN 1 ELSE 0 END AS c FROM gaps),
      (SELECT CASE WHEN avg(CASE WHEN dl <= 0 THEN 1.0 ELSE 0.0 END) FILTER (dl IS NOT NULL) >= 0.5 THEN 1 ELSE 0 END AS e
       FROM (SELECT failure_within_days - lag(failure_within_days) OVER ({_SERIES}) AS dl FROM life)),
      (SELECT CASE WHEN max(k) = 1 THEN 1 ELSE 0 END AS f FROM (SELECT count(*) AS k FROM gaps GROUP BY "timestamp", machine_id))""",
)))
def q_expectations(spark, d):
    return quality.expectations_stage(v.with_life(_table(spark, d)), life="failure_within_days")


@query("q_cardinality", sql("gaps", _line(
    "CARDINALITY", _WARN, "n", "CASE WHEN n > 0 THEN t ELSE 'none' END",
    "SELECT len(l) AS n, array_to_string(list_slice(list_sort(l), 1, 8), ', ') AS t FROM (SELECT list_filter(["
    + ", ".join(f"CASE WHEN count(DISTINCT \"{c}\") > greatest(50, floor(0.5 * count(*))) THEN '{c}' END" for c in COLUMNS)
    + "], lambda x: x IS NOT NULL) AS l FROM gaps)",
)))
def q_cardinality(spark, d):
    return quality.cardinality_stage(_table(spark, d))


# ---------------------------------------------------------------- association rules
_HIGH = ("temperature", "vibration", "pressure", "rpm", "oil_pressure", "failure")
_ITEMS = "list_filter(['event_type=' || event_type, " + ", ".join(
    f"CASE WHEN {c} >= (SELECT CAST(quantile_cont({c}, 0.9) AS DOUBLE) FROM gaps) THEN '{c}=HIGH' END" for c in _HIGH) + "], lambda x: x IS NOT NULL)"
_BASKETS = f"SELECT event_id, items FROM (SELECT event_id, {_ITEMS} AS items FROM gaps) WHERE len(items) >= 2"
_LONG = "SELECT event_id, unnest(items) AS item FROM baskets"
_ASSOC = dict(baskets=_BASKETS, long_items=_LONG, counted="""
  SELECT x.item AS a, y.item AS b, count(*) AS n FROM long_items x JOIN long_items y ON x.event_id = y.event_id AND x.item < y.item
  GROUP BY 1, 2 ORDER BY n DESC, a, b LIMIT 30""", single="SELECT item, count(*) AS m FROM long_items GROUP BY 1",
  rules="""SELECT a, b, n, t.k AS baskets, n / t.k AS support, greatest(n / p.m, n / q.m) AS confidence
  FROM counted JOIN single p ON p.item = a JOIN single q ON q.item = b, (SELECT count(*) AS k FROM baskets) t""")


@query("assoc_pairs", sql("gaps", "SELECT a, b, n, baskets, round(support, 6) AS support, round(confidence, 6) AS confidence FROM rules", **_ASSOC))
def assoc_pairs(spark, d):
    out = quality.association_pairs(quality.association_baskets(_table(spark, d)))
    return out.withColumns({c: F.round(c, 6) for c in ("support", "confidence")})


@query("q_association", sql("gaps", _line(
    "ASSOCIATION RULES", "CASE WHEN odd > 0 THEN 'WARN' ELSE 'PASS' END", "n",
    "CAST(n AS VARCHAR) || ' rules, ' || CAST(odd AS VARCHAR) || ' suspicious'",
    """SELECT count(*) FILTER (support >= 0.05 AND confidence >= 0.55) AS n,
       least(8, count(*) FILTER (support >= 0.05 AND confidence >= 0.55 AND round(confidence, 3) >= 0.7 AND (contains(a, 'HIGH') OR contains(b, 'HIGH')))) AS odd
       FROM rules""",
), **_ASSOC))
def q_association(spark, d):
    return quality.association_stage(_table(spark, d))


# ---------------------------------------------------------------- stages without SQL
@query("q_forest")
def q_forest(spark, d):
    return quality.forest_stage(_table(spark, d))


@query("q_dbscan")
def q_dbscan(spark, d):
    from ...operators.density import dbscan_stage

    return dbscan_stage(_table(spark, d))


# Twelve indicators from five sensors; the SQL standardises them as the operator does.
_INDICATORS = {
    "temperature": "temperature", "vibration": "vibration", "pressure": "pressure", "rpm": "rpm", "oil_pressure": "oil_pressure",
    "shake_power": "vibration * vibration", "heat_load": "temperature * vibration", "slip": "pressure - oil_pressure",
    "specific_heat": "temperature / pressure", "speed_load": "rpm * pressure / 1000", "oil_margin": "oil_pressure / temperature",
    "shake_per_turn": "vibration * 1000 / rpm",
}


@query("dbscan_twelve_columns", sql("readings",
    "SELECT count(*) AS n_rows, count(*) FILTER (reach = 0) AS noise_points, count(*) FILTER (core) AS core_points FROM ("
    "SELECT a.i, any_value(a.core) AS core, count(b.i) FILTER (b.core) AS reach FROM cores a JOIN cores b ON " + " + ".join(
        f"pow(a.{c} - b.{c}, 2)" for c in _INDICATORS) + " <= 0.64 GROUP BY a.i)",
    named="SELECT event_id AS i, " + ", ".join(f"{e} AS {c}" for c, e in _INDICATORS.items()) + " FROM readings",
    z="SELECT i, " + ", ".join(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS {c}" for c in _INDICATORS) + " FROM named "
      "WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in _INDICATORS),
    cores="SELECT z.*, n >= 5 AS core FROM z JOIN (SELECT a.i, count(*) AS n FROM z a JOIN z b ON " + " + ".join(
        f"pow(a.{c} - b.{c}, 2)" for c in _INDICATORS) + " <= 0.64 GROUP BY a.i) USING (i)"))
def dbscan_twelve_columns(spark, d):
    from ...operators.density import dbscan

    table = v.readings(spark, d).selectExpr(*[f"{e} AS {c}" for c, e in _INDICATORS.items()])
    return dbscan(table, list(_INDICATORS)).drop("clusters")


@query("q_kmeans")
def q_kmeans(spark, d):
    return quality.kmeans_stage(_table(spark, d))


@query("q_pca")
def q_pca(spark, d):
    return quality.pca_stage(_table(spark, d))


@query("quality_report")
def report(spark, d):
    return quality.quality_report(_table(spark, d))
