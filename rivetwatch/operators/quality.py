"""Nineteen data-quality checks.

Stages that are plain statistics share two aggregates: the first gathers
column statistics, the second counts what falls outside them.  A stage only
declares what it needs from each pass, so one stage alone costs only its own
aggregates and the full report still scans twice.
"""

from __future__ import annotations

from functools import reduce
from typing import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..constants import JUMP_NAME_HINTS, QUALITY_CONTAMINATION, RUL_SEED
from ..functions.columns import Keys, find_col, numeric_columns, string_columns
from ..functions.quantiles import quantiles
from .series import SeriesProfile, add_windowed, spread_rows
from .stats import duplicate_counts, safe_corr

STAGES = (
    "NULLS", "CONSTANT", "ZEROS", "DUPLICATES", "Z-SCORE", "IQR", "ISOLATION FOREST", "DBSCAN NOISE",
    "KMEANS DISTANCE", "IMPOSSIBLE JUMP", "SENSOR CORRELATION", "EXPECTATIONS", "CARDINALITY", "DIRTY LABELS",
    "PCA DRIFT", "DOMAIN RULES", "ASSOCIATION RULES", "SCHEMA / ROWCOUNT", "TIMESTAMP PRESENT",
)
_ROW_SCHEMA = "check string, status string, metric double, detail string"


def _row(check: str, status: Column, metric: Column, detail: Column) -> Column:
    return F.struct(
        F.lit(check).alias("check"), status.alias("status"), metric.cast("double").alias("metric"), detail.alias("detail")
    )


def _text(c: Column) -> Column:
    return c.cast("long").cast("string")


class _Plan:
    """Collects what the chosen stages need, then runs it in two passes."""

    def __init__(self, df: DataFrame, keys: Keys, label: str | None, life: str | None):
        self.df, self.keys, self.label, self.life = df, keys, label, life
        self.columns = [c for c in df.columns if c != keys.tie]
        self.numbers = [c for c in numeric_columns(df) if c != keys.tie]
        self._first: dict[str, Column] = {}
        self._second: dict[str, Column] = {}
        self._quantiles: set[tuple[str, float]] = set()
        self._steps: set[str] = set()

    def col(self, *names: str) -> str | None:
        return find_col(self.columns, *names)

    def first(self, name: str, expr: Column) -> Column:
        self._first[name] = expr
        return F.col(name)

    def second(self, name: str, expr: Column) -> Column:
        self._second[name] = expr
        return F.col(name)

    def quantile(self, c: str, p: float) -> Column:
        self._quantiles.add((c, p))
        return F.col(f"q__{c}__{int(round(p * 100))}")

    def delta(self, c: str) -> Column:
        """Change since the asset's previous row."""
        self._steps.add(c)
        return F.col(f"d__{c}")

    def n(self) -> Column:
        return self.first("n_rows", F.count(F.lit(1)))

    def known(self, c: str) -> Column:
        return self.first(f"known__{c}", F.count(c))

    def mean(self, c: str) -> Column:
        return self.first(f"mean__{c}", F.avg(c))

    def std(self, c: str) -> Column:
        return self.first(f"std__{c}", F.stddev_samp(c))

    def run(self, rows: list[Column], profile: SeriesProfile | None) -> DataFrame:
        self.n()
        stats = self.df.agg(*[e.alias(k) for k, e in self._first.items()])
        if self._quantiles:
            cols = sorted({c for c, _ in self._quantiles})
            probs = sorted({p for _, p in self._quantiles})
            known = profile.rows if profile else None
            q = quantiles(self.df, cols, probs, group_rows=known).select(
                *[
                    F.col(c)[probs.index(p)].alias(f"q__{c}__{int(round(p * 100))}")
                    for c, p in sorted(self._quantiles)
                ]
            )
            stats = stats.crossJoin(F.broadcast(q))
        if self._second:
            base = self.df
            if self._steps:
                moves = {
                    f"d__{c}": (lambda w, c=c: F.col(c) - F.lag(c).over(w)) for c in sorted(self._steps)
                }
                base = add_windowed(base, moves, 1, self.keys, profile)
            counts = base.crossJoin(F.broadcast(stats)).agg(*[e.alias(k) for k, e in self._second.items()])
            stats = counts.crossJoin(F.broadcast(stats))
        return stats.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


# ---------------------------------------------------------------- aggregate stages
def _nulls(p: _Plan) -> Column:
    missing = sum((p.n() - p.known(c) for c in p.columns), F.lit(0))
    share = missing / F.greatest(p.n() * len(p.columns), F.lit(1))
    status = F.when(share > 0.2, "FAIL").when(share > 0.05, "WARN").otherwise("PASS")
    return _row("NULLS", status, F.round(share, 6), F.concat(F.format_string("%.2f", share * 100), F.lit("% missing")))


def _constant(p: _Plan) -> Column:
    """A column is constant when its smallest and largest values agree; no distinct count needed."""
    flat = []
    for c in p.columns:
        same = p.first(f"same__{c}", F.coalesce(F.min(c) == F.max(c), F.lit(True)))
        flat.append(F.when(same, F.lit(c)))
    names = F.array_compact(F.array(*flat))
    status = F.when(F.size(names) > 0, "FAIL").otherwise("PASS")
    detail = F.when(F.size(names) > 0, F.array_join(F.slice(names, 1, 6), ", ")).otherwise("none")
    return _row("CONSTANT", status, F.size(names), detail)


def _zeros(p: _Plan) -> Column:
    zeros = sum((p.first(f"zero__{c}", F.count_if(F.col(c) == 0)) for c in p.numbers), F.lit(0))
    share = zeros / F.greatest(p.n() * len(p.numbers), F.lit(1))
    detail = F.concat(F.format_string("%.1f", share * 100), F.lit("% zeros"))
    return _row("ZEROS", F.when(share > 0.3, "WARN").otherwise("PASS"), F.round(share, 6), detail)


def _zscore(p: _Plan) -> Column:
    hits = F.lit(0)
    for c in p.numbers:
        far = F.abs((F.col(c) - p.mean(c)) / (p.std(c) + 1e-9)) > 3
        hits = hits + F.when(p.known(c) >= 5, p.second(f"z__{c}", F.count_if(far))).otherwise(0)
    return _row("Z-SCORE", F.when(hits > 0, "WARN").otherwise("PASS"), hits, F.concat(_text(hits), F.lit(" hits")))


def _iqr(p: _Plan) -> Column:
    hits = F.lit(0)
    for c in p.numbers:
        q1, q3 = p.quantile(c, 0.25), p.quantile(c, 0.75)
        out = (q3 != q1) & ((F.col(c) < q1 - 1.5 * (q3 - q1)) | (F.col(c) > q3 + 1.5 * (q3 - q1)))
        hits = hits + F.when(p.known(c) >= 5, p.second(f"iqr__{c}", F.count_if(out))).otherwise(0)
    return _row("IQR", F.when(hits > 0, "WARN").otherwise("PASS"), hits, F.concat(_text(hits), F.lit(" hits")))


def _jumps(p: _Plan) -> Column:
    """Change per asset between neighbouring rows that no machine can make."""
    total, parts = F.lit(0), []
    for c in p.numbers:
        low = c.lower()
        if not any(h in low for h in JUMP_NAME_HINTS):
            continue
        if "temp" in low:
            limit = F.lit(50.0)
        elif "vib" in low:
            limit = F.lit(5.0)
        elif "pressure" in low:
            limit = F.lit(30.0)
        else:
            spread = p.std(c)
            limit = F.when(spread.isNull() | (spread == 0), 1.0).otherwise(spread) * 4
        n = p.second(f"jump__{c}", F.count_if(F.abs(p.delta(c)) > limit))
        parts.append(F.when(n > 0, F.concat(F.lit(c + ":"), _text(n))))
        total = total + n
    listed = F.array_join(F.array_compact(F.array(*parts)), ", ") if parts else F.lit("")
    detail = F.when(listed == "", "none").otherwise(listed)
    return _row("IMPOSSIBLE JUMP", F.when(total > 0, "FAIL").otherwise("PASS"), total, detail)


def _correlation(p: _Plan) -> Column:
    """Sensor pairs that should move together but do not."""
    t, pr, v = p.col("temperature", "temp"), p.col("pressure"), p.col("vibration", "vib")
    dead = []
    for a, b in ((t, pr), (t, v), (pr, v)):
        if a and b:
            r = F.round(p.first(f"r__{a}__{b}", safe_corr(a, b)), 3)
            dead.append(F.when(F.abs(r) < 0.05, F.lit(f"{a}|{b}")))
    names = F.array_compact(F.array(*dead)) if dead else F.array().cast("array<string>")
    detail = F.when(F.size(names) > 0, F.array_join(names, ", ")).otherwise("none")
    return _row("SENSOR CORRELATION", F.when(F.size(names) > 0, "WARN").otherwise("PASS"), F.size(names), detail)


def _labels(p: _Plan) -> Column:
    """Failures on calm rows, and healthy labels on extreme ones."""
    vib = p.col("vibration", "vib")
    if not p.label or not vib:
        return _row("DIRTY LABELS", F.lit("PASS"), F.lit(0), F.lit("no label column"))
    label = F.coalesce(F.col(p.label).cast("double"), F.lit(0.0))
    calm = p.second("label_calm", F.count_if((label == 1) & (F.col(vib) < p.quantile(vib, 0.2))))
    wild = p.second("label_wild", F.count_if((label == 0) & (F.col(vib) > p.quantile(vib, 0.95))))
    detail = F.concat_ws(
        "; ",
        F.when(calm > 0, F.concat(_text(calm), F.lit(" failures on calm rows"))),
        F.when(wild > 0, F.concat(_text(wild), F.lit(" rows without failure shake hard"))),
    )
    dirty = calm + wild
    return _row("DIRTY LABELS", F.when(dirty > 0, "WARN").otherwise("PASS"), dirty, F.when(detail == "", "none").otherwise(detail))


def _domain(p: _Plan) -> Column:
    flags = []
    t, v, pr = p.col("temperature", "temp"), p.col("vibration", "vib"), p.col("pressure")
    speed = p.col("speed", "flow", "load", "rpm")
    if t and v:
        stuck = p.second("stuck", F.count_if((F.col(t) > 150) & (F.col(v) < 0.1)))
        flags.append(F.when(stuck > 0, F.concat(_text(stuck), F.lit(" hot rows without vibration"))))
    if pr and speed:
        leak = p.second("leak", F.count_if((p.delta(pr) < -10) & (F.abs(p.delta(speed)) < 0.5)))
        flags.append(F.when(leak > 0, F.concat(_text(leak), F.lit(" pressure drops at steady speed"))))
    if p.life:
        rising = p.second("life_up", F.avg((p.delta(p.life) > 0).cast("double")))
        flags.append(F.when(rising > 0.6, F.lit("remaining life mostly grows")))
    if p.label and v:
        spread = F.when(p.std(v).isNull() | (p.std(v) == 0), 1.0).otherwise(p.std(v))
        quiet = F.coalesce(F.col(p.label).cast("double"), F.lit(0.0)) == 0
        missed = p.second("missed", F.count_if(quiet & (F.col(v) > p.mean(v) + 3 * spread)))
        flags.append(F.when(missed > 0, F.concat(_text(missed), F.lit(" rows far above usual vibration and no failure"))))
    found = F.array_compact(F.array(*flags)) if flags else F.array().cast("array<string>")
    detail = F.when(F.size(found) > 0, F.array_join(found, "; ")).otherwise("all rules hold")
    return _row("DOMAIN RULES", F.when(F.size(found) > 0, "FAIL").otherwise("PASS"), F.size(found), detail)


def _rowcount(p: _Plan) -> Column:
    detail = F.concat(_text(p.n()), F.lit(f" rows × {len(p.columns)} cols"))
    return _row("SCHEMA / ROWCOUNT", F.when(p.n() > 0, "PASS").otherwise("FAIL"), p.n(), detail)


def _timestamp(p: _Plan) -> Column:
    found = p.col("timestamp", "date", "time", "datetime")
    return _row("TIMESTAMP PRESENT", F.lit("PASS" if found else "WARN"), F.lit(1 if found else 0), F.lit(found or "missing"))


_AGGREGATE: dict[str, Callable[[_Plan], Column]] = {
    "NULLS": _nulls, "CONSTANT": _constant, "ZEROS": _zeros, "Z-SCORE": _zscore, "IQR": _iqr,
    "IMPOSSIBLE JUMP": _jumps, "SENSOR CORRELATION": _correlation, "DIRTY LABELS": _labels,
    "DOMAIN RULES": _domain, "SCHEMA / ROWCOUNT": _rowcount, "TIMESTAMP PRESENT": _timestamp,
}


# ---------------------------------------------------------------- stages with their own plan
def duplicates_stage(df: DataFrame, keys: Keys = Keys()) -> DataFrame:
    n = F.col("dup_rows")
    row = _row("DUPLICATES", F.when(n > 0, "WARN").otherwise("PASS"), n, F.concat(_text(n), F.lit(" dup rows")))
    return duplicate_counts(df.drop(keys.tie)).select(row.alias("r")).select("r.*")


def expectations_stage(
    df: DataFrame, keys: Keys = Keys(), life: str | None = None, profile: SeriesProfile | None = None,
    max_rows: int | None = None,
) -> DataFrame:
    """Null share per column, temperature range, falling life, unique keys, row count (up to ``max_rows``, if given)."""
    p = _Plan(df, keys, None, life)
    checks = [(p.n() - p.known(c)) / F.greatest(p.n(), F.lit(1)) < 0.2 for c in p.columns]
    t = p.col("temperature", "temp")
    if t:
        low, high = p.first("t_low", F.min(t)), p.first("t_high", F.max(t))
        checks.append(F.coalesce((low >= 0) & (high <= 200), F.lit(False)))
    if life:
        falling = p.second("life_down", F.avg((p.delta(life) <= 0).cast("double")))
        checks.append(F.when(p.known(life) > 3, F.coalesce(falling >= 0.5, F.lit(False))).otherwise(True))
    checks.append((p.n() >= 1) & (p.n() <= max_rows) if max_rows else p.n() >= 1)
    passed = sum((c.cast("int") for c in checks), F.lit(0))
    row = p.run([F.struct(passed.alias("passed"))], profile)
    dup = duplicate_counts(df, [keys.ts, keys.id])
    total = len(checks) + 1
    ok = F.col("passed") + (F.col("dup_rows") == 0).cast("int")
    detail = F.concat(_text(ok), F.lit(f"/{total} passed"))
    made = _row("EXPECTATIONS", F.when(ok == total, "PASS").otherwise("WARN"), ok, detail)
    return row.crossJoin(F.broadcast(dup)).select(made.alias("r")).select("r.*")


def cardinality_stage(df: DataFrame, keys: Keys = Keys(), exact: bool = True) -> DataFrame:
    """Columns with more distinct values than max(50, half the rows).

    A sketch of all columns comes first; with ``exact``, columns within five of its standard deviations of the limit
    are counted value by value, and only those are shuffled.
    """
    cols = [c for c in df.columns if c != keys.tie]
    rsd = 0.02
    one = df.agg(F.count(F.lit(1)).alias("n"), F.struct(*[F.approx_count_distinct(c, rsd).alias(c) for c in cols]).alias("d")).first()
    rough, limit = one["d"].asDict(), max(50, one["n"] // 2)
    near = [c for c in cols if exact and abs(rough[c] - limit) <= 5 * rsd * limit + 1]
    spark = df.sparkSession
    per = spark.createDataFrame([(c, rough[c]) for c in cols if c not in near], "c string, d long")
    if near:
        cells = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in near])
        values = df.select(F.explode(cells).alias("x")).select("x.*").filter(F.col("v").isNotNull()).distinct()
        per = per.unionByName(values.groupBy("c").agg(F.count(F.lit(1)).alias("d")))
    n = spark.createDataFrame([(one["n"],)], "n long")
    high = F.col("d") > F.greatest(F.lit(50), F.floor(0.5 * F.col("n")))
    names = F.sort_array(F.collect_list(F.when(high, F.col("c"))))
    row = per.crossJoin(F.broadcast(n)).agg(names.alias("names"))
    made = _row(
        "CARDINALITY", F.when(F.size("names") > 0, "WARN").otherwise("PASS"), F.size("names"),
        F.when(F.size("names") > 0, F.array_join(F.slice("names", 1, 8), ", ")).otherwise("none"),
    )
    return row.select(made.alias("r")).select("r.*")


def _info(df: DataFrame, check: str, why: str) -> DataFrame:
    return df.sparkSession.createDataFrame([(check, "INFO", None, why)], _ROW_SCHEMA)


def forest_stage(df: DataFrame, keys: Keys = Keys(), contamination: float = QUALITY_CONTAMINATION) -> DataFrame:
    from .iforest import fit_annotate

    numbers = [c for c in numeric_columns(df) if c != keys.tie]
    complete = df.na.drop(subset=numbers)
    if len(numbers) < 2 or complete.limit(15).count() < 15:
        return _info(df, "ISOLATION FOREST", "need >=2 numeric cols & 15 rows")
    _, scored = fit_annotate(complete, numbers, contamination, keys=keys)
    counted = scored.agg(F.count_if("is_anomaly").alias("a"), F.count(F.lit(1)).alias("n"))
    rate = F.round(100.0 * F.col("a") / F.col("n"), 2)
    made = _row(
        "ISOLATION FOREST", F.when(F.col("a") > 0, "WARN").otherwise("PASS"), F.col("a"),
        F.concat(_text(F.col("a")), F.lit(" anomalies, "), rate.cast("string"), F.lit("%")),
    )
    return counted.select(made.alias("r")).select("r.*")


def kmeans_stage(df: DataFrame, keys: Keys = Keys(), seed: int = RUL_SEED) -> DataFrame:
    """Rows further from their cluster centre than mean + 2 population deviations."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    numbers = [c for c in numeric_columns(df) if c != keys.tie]
    complete = df.select(keys.tie, *[F.col(c).cast("double").alias(c) for c in numbers]).na.drop(subset=numbers)
    few = complete.limit(20).count()
    if len(numbers) < 2 or few < 20:
        return _info(df, "KMEANS DISTANCE", "need more numeric rows")
    rows = VectorAssembler(inputCols=numbers, outputCol="raw").transform(complete)
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True).fit(rows)
    scaled = spread_rows(scaler.transform(rows).select("features", keys.tie), keys.tie)
    try:
        model = KMeans(k=3, seed=seed, maxIter=30).fit(scaled)
        centers = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in model.clusterCenters()])
        x = vector_to_array("features")
        gap = F.zip_with(x, F.get(centers, F.col("prediction")), lambda a, b: (a - b) * (a - b))
        dist = F.sqrt(F.aggregate(gap, F.lit(0.0), lambda acc, v: acc + v))
        measured = model.transform(scaled).select(dist.alias("d"))
        bar = measured.agg((F.avg("d") + 2 * F.stddev_pop("d")).alias("bar"))
        far = measured.crossJoin(F.broadcast(bar)).agg(F.count_if(F.col("d") > F.col("bar")).alias("far")).first()["far"]
    finally:
        scaled.unpersist()
    row = ("KMEANS DISTANCE", "WARN" if far else "PASS", float(far), f"{far} far from cluster")
    return df.sparkSession.createDataFrame([row], _ROW_SCHEMA)


def pca_stage(df: DataFrame, keys: Keys = Keys(), rows: int | None = None) -> DataFrame:
    """Variance carried by three components, early half against late half.

    Halves split at the median time.  Both correlation matrices come from one
    aggregate; only those small matrices meet numpy, inside a task.
    """
    numbers = [c for c in numeric_columns(df) if c != keys.tie]
    complete = df.na.drop(subset=numbers).withColumn("__us", F.unix_micros(F.col(keys.ts).cast("timestamp")).cast("double"))
    if len(numbers) < 2 or complete.limit(30).count() < 30:
        return _info(df, "PCA DRIFT", "need more numeric rows")
    mid = quantiles(complete, ["__us"], [0.5], group_rows=rows).select(F.col("__us")[0].alias("__mid"))
    split = complete.crossJoin(F.broadcast(mid))
    early = F.col("__us") < F.col("__mid")
    halves = split.select(
        *[F.when(early, F.col(c).cast("double")).alias(f"e{i}") for i, c in enumerate(numbers)],
        *[F.when(~early, F.col(c).cast("double")).alias(f"l{i}") for i, c in enumerate(numbers)],
    )
    d = len(numbers)
    upper = [(i, j) for i in range(d) for j in range(i, d)]
    one = halves.agg(
        *[
            F.array(*[F.coalesce(F.covar_pop(f"{h}{i}", f"{h}{j}"), F.lit(0.0)) for i, j in upper]).alias(h)
            for h in "el"
        ]
    )

    def share(cells) -> float:
        cov = np.zeros((d, d))
        for (i, j), value in zip(upper, cells):
            cov[i, j] = cov[j, i] = value
        live = np.flatnonzero(np.diag(cov) > 0)
        if len(live) == 0:
            return 0.0
        kept = cov[np.ix_(live, live)]
        scale = np.sqrt(np.diag(kept))
        values = np.linalg.eigvalsh(kept / np.outer(scale, scale))
        return float(np.sort(values)[::-1][:3].sum() / len(live))

    def shares(batches):
        for batch in batches:
            yield pd.DataFrame({"early": batch["e"].map(share), "late": batch["l"].map(share)})

    ratio = one.mapInPandas(shares, "early double, late double")
    drift = F.abs(F.col("early") - F.col("late"))
    made = _row(
        "PCA DRIFT", F.when(drift > 0.15, "WARN").otherwise("PASS"), F.round(drift, 3),
        F.concat(F.lit("early "), F.format_string("%.3f", F.col("early")), F.lit(", late "), F.format_string("%.3f", F.col("late"))),
    )
    return ratio.select(made.alias("r")).select("r.*")


# ---------------------------------------------------------------- association rules
def association_baskets(
    df: DataFrame, keys: Keys = Keys(), tail_rows: int | None = None, rows: int | None = None,
    most_texts: int | None = None, most_numbers: int | None = None,
) -> DataFrame:
    """One sorted item array per row: every text column of at most twelve values and a ``=HIGH`` flag per number.

    ``most_texts`` and ``most_numbers`` limit the columns, if given.
    """
    texts = string_columns(df, [keys.tie])
    small: list[str] = []
    if texts:
        rough = df.agg(*[F.approx_count_distinct(c).alias(c) for c in texts]).first()
        near = [c for c in texts if rough[c] <= 24]
        exact = df.agg(*[F.count_distinct(c).alias(c) for c in near]).first() if near else {}
        small = [c for c in near if exact[c] <= 12][:most_texts]
    numbers = [c for c in numeric_columns(df) if c != keys.tie][:most_numbers]
    if tail_rows:
        df = df.orderBy(*[F.col(c).desc() for c in keys.order]).limit(tail_rows)
    bars = quantiles(df, numbers, [0.9], group_rows=rows).select(*[F.col(c)[0].alias(f"__{c}") for c in numbers])
    joined = df.crossJoin(F.broadcast(bars))
    items = [F.when(F.col(c).isNotNull(), F.concat(F.lit(c + "="), F.col(c))) for c in small]
    items += [F.when(F.col(c) >= F.col(f"__{c}"), F.lit(c + "=HIGH")) for c in numbers]
    return joined.select(F.array_sort(F.array_compact(F.array(*items))).alias("items")).filter(F.size("items") >= 2)


def association_pairs(baskets: DataFrame, top: int = 30) -> DataFrame:
    """Most frequent item pairs with support and confidence.

    A row yields the pairs of its own items, one per column; pairs are counted
    on the map side before they move.
    """
    pairs = F.flatten(
        F.transform(
            "items",
            lambda x, i: F.transform(F.filter("items", lambda y, j: j > i), lambda y: F.struct(x.alias("a"), y.alias("b"))),
        )
    )
    counted = baskets.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n"))
    leading = counted.orderBy(F.col("n").desc(), "a", "b").limit(top)
    single = baskets.select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("m"))
    total = baskets.agg(F.count(F.lit(1)).alias("baskets"))
    joined = (
        leading.join(single.select(F.col("item").alias("a"), F.col("m").alias("m_a")), "a")
        .join(single.select(F.col("item").alias("b"), F.col("m").alias("m_b")), "b")
        .crossJoin(F.broadcast(total))
    )
    conf = F.greatest(F.col("n") / F.col("m_a"), F.col("n") / F.col("m_b"))
    return joined.select("a", "b", "n", "baskets", (F.col("n") / F.col("baskets")).alias("support"), conf.alias("confidence"))


def association_stage(df: DataFrame, keys: Keys = Keys(), rows: int | None = None) -> DataFrame:
    pairs = association_pairs(association_baskets(df, keys, rows=rows))
    rule = (F.col("baskets") >= 20) & (F.col("support") >= 0.05) & (F.col("confidence") >= 0.55)
    high = rule & (F.col("a").contains("HIGH") | F.col("b").contains("HIGH")) & (F.round("confidence", 3) >= 0.7)
    row = pairs.agg(
        F.count_if(rule).alias("rules"), F.least(F.count_if(high), F.lit(8)).alias("odd"),
    )
    made = _row(
        "ASSOCIATION RULES", F.when(F.col("odd") > 0, "WARN").otherwise("PASS"), F.col("rules"),
        F.concat(_text(F.col("rules")), F.lit(" rules, "), _text(F.col("odd")), F.lit(" suspicious")),
    )
    return row.select(made.alias("r")).select("r.*")


# ---------------------------------------------------------------- report
def run_stages(
    df: DataFrame,
    stages: list[str],
    keys: Keys = Keys(),
    label: str | None = "failure",
    life: str | None = "failure_within_days",
    profile: SeriesProfile | None = None,
) -> DataFrame:
    """Any subset of the aggregate stages in one two-pass plan."""
    label = label if label in df.columns else None
    life = life if life in df.columns else None
    p = _Plan(df, keys, label, life)
    return p.run([_AGGREGATE[s](p) for s in stages], profile)


def quality_report(
    df: DataFrame,
    keys: Keys = Keys(),
    label: str | None = "failure",
    life: str | None = "failure_within_days",
    profile: SeriesProfile | None = None,
    models: bool = True,
) -> DataFrame:
    """All nineteen checks as rows; ``models=False`` leaves out the three that train a model."""
    from .density import dbscan_stage

    life_col = life if life in df.columns else None
    parts = [
        run_stages(df, list(_AGGREGATE), keys, label, life, profile),
        duplicates_stage(df, keys),
        expectations_stage(df, keys, life_col, profile),
        cardinality_stage(df, keys),
        pca_stage(df, keys),
        association_stage(df, keys),
    ]
    if models:
        parts += [forest_stage(df, keys), dbscan_stage(df, keys), kmeans_stage(df, keys)]
    every = reduce(DataFrame.unionByName, parts)
    position = F.array_position(F.array(*map(F.lit, STAGES)), F.col("check")).cast("int")
    return every.withColumn("position", position)
