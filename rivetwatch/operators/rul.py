"""Remaining useful life: window features, distributed random forest, proxy labels, search."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, functions as F
from pyspark.util import inheritable_thread_target

from ..constants import CORE_SENSORS, PROXY_NOTE, ROLLING_WINDOW, RUL_SEED
from ..functions.columns import Keys, sensor_columns
from ..functions.scalars import is_valid_asset, risk_from_rul
from .search import Axis, search, winner
from .series import SeriesProfile, add_windowed, latest_per_asset, rolling_mean, rolling_std, spread_rows, step
from .whole import add_windowed_whole

LABEL = "failure_within_days"
# Histograms that one task of a forest holds at a time.  Each core of an executor holds as many and their serialised copies:
# with four cores this is half a gigabyte.  A forest whose levels need more takes more passes and comes out the same.
HISTOGRAM_MB = 128


def rul_features(
    df: DataFrame, keys: Keys = Keys(), window: int = ROLLING_WINDOW, profile: SeriesProfile | None = None
) -> DataFrame:
    """Rolling mean, rolling deviation and first difference per sensor: one exchange, one sort.

    A table without the asset column is one series: its windows run over all rows by time.
    """
    sensors = [c for c in CORE_SENSORS if c in df.columns] or sensor_columns(df, keys)
    exprs = {}
    for c in sensors:
        exprs[f"{c}_roll_mean"] = rolling_mean(c, window)
        exprs[f"{c}_roll_std"] = rolling_std(c, window)
        exprs[f"{c}_trend"] = lambda w, c=c: F.coalesce(step(c)(w), F.lit(0.0))
    if keys.id not in df.columns:
        return add_windowed_whole(df, exprs, window - 1, [c for c in keys.order if c in df.columns])
    return add_windowed(df, exprs, window - 1, keys, profile)


def feature_names(featured: DataFrame, keys: Keys = Keys()) -> list[str]:
    """Sensors and window features; never keys, labels, verdicts, bins or smoothed copies."""
    plain = sensor_columns(featured, keys)
    derived = [c for c in featured.columns if c.endswith(("_roll_mean", "_roll_std", "_trend"))]
    return plain + derived


def proxy_rul(df: DataFrame, sensors: tuple = CORE_SENSORS) -> DataFrame:
    """Add ``proxy_rul``: 1..30 days from how close the core sensors run to their fleet maxima."""
    cols = [c for c in sensors if c in df.columns]
    if not cols:
        raise ValueError("proxy labels need at least one core sensor")
    tops = df.agg(*[F.max(c).alias(f"__{c}") for c in cols])
    wear = sum((F.col(c) / (F.col(f"__{c}") + 1e-6) for c in cols), F.lit(0.0))
    worn = df.crossJoin(F.broadcast(tops)).withColumn("__wear", wear)
    most = worn.agg(F.max("__wear").alias("__most"))
    rul = (1 - F.col("__wear") / (F.col("__most") + 1e-6)) * 30 + 1
    out = worn.crossJoin(F.broadcast(most))
    bounded = F.when(F.col("__wear").isNotNull(), F.least(F.greatest(rul, F.lit(1.0)), F.lit(30.0)))
    return out.withColumn("proxy_rul", bounded).select(*df.columns, "proxy_rul")


@dataclass(frozen=True)
class RulModel:
    model: object
    features: list
    metrics: dict
    is_proxy: bool
    label_source: str

    def importances(self, spark) -> DataFrame:
        """Feature weights, heaviest first (one row per feature)."""
        weights = self.model.featureImportances.toArray()
        rows = [(f, float(w)) for f, w in zip(self.features, weights)]
        return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.col("importance").desc(), "feature")

    def predict(self, featured: DataFrame) -> DataFrame:
        return self.model.transform(_assemble(featured, self.features))


def _assemble(df: DataFrame, features: list[str]) -> DataFrame:
    filled = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features})
    return VectorAssembler(inputCols=features, outputCol="features").transform(filled)


def fit_rul(
    featured: DataFrame,
    keys: Keys = Keys(),
    trees: int = 100,
    depth: int = 12,
    seed: int = RUL_SEED,
) -> RulModel:
    """Random forest on the labelled rows, or on proxy labels when there are none.

    The 80/20 split is by row hash, so it does not move with partitioning.
    """
    proxy = LABEL not in featured.columns or featured.filter(F.col(LABEL).isNotNull()).isEmpty()
    labelled = proxy_rul(featured).withColumn("label", F.col("proxy_rul")) if proxy else featured.withColumn("label", F.col(LABEL).cast("double"))
    names = [c for c in feature_names(featured, keys) if c != "proxy_rul"]
    part = F.pmod(F.xxhash64(keys.id, keys.ts, keys.tie), F.lit(5))
    rows = _assemble(labelled.filter(F.col("label").isNotNull()), names).select("features", "label", part.alias("part"), keys.id, keys.ts, keys.tie)
    rows = spread_rows(rows, keys.id, keys.ts, keys.tie)
    try:
        forest = RandomForestRegressor(
            numTrees=trees, maxDepth=depth, featureSubsetStrategy="all", seed=seed, subsamplingRate=1.0,
            maxMemoryInMB=HISTOGRAM_MB,
        )
        model = forest.fit(rows.filter("part > 0"))
        metrics = regression_metrics(model.transform(rows.filter("part = 0")))
    finally:
        rows.unpersist()
    source = "synthetic_degradation_proxy" if proxy else LABEL
    return RulModel(model, names, metrics, proxy, source)


def regression_metrics(predicted: DataFrame, digits: int = 3) -> dict:
    """MAE, RMSE and R2 from one aggregate."""
    err = F.col("label") - F.col("prediction")
    row = predicted.agg(
        F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"),
        F.sum(err * err).alias("sse"), (F.var_pop("label") * F.count("label")).alias("sst"),
    ).first()
    r2 = 1 - row["sse"] / row["sst"] if row["sst"] else None
    return {k: None if v is None else round(v, digits) for k, v in (("mae", row["mae"]), ("rmse", row["rmse"]), ("r2", r2))}


def predict_latest(model: RulModel, featured: DataFrame, keys: Keys = Keys()) -> DataFrame:
    """One prediction per valid asset, from its newest row."""
    cols = list(dict.fromkeys([keys.ts, keys.tie, *model.features]))
    newest = latest_per_asset(featured.filter(is_valid_asset(F.col(keys.id))), cols, keys)
    days = F.greatest(F.lit(1), F.bround("prediction", 0).cast("int"))
    return predictions_table(
        model.predict(newest).select(F.trim(keys.id).alias(keys.id), days.alias("predicted_rul_days")),
        model.is_proxy, model.label_source, keys,
    )


def predictions_table(days: DataFrame, is_proxy: bool, source: str, keys: Keys = Keys()) -> DataFrame:
    """Attach risk, message and provenance to ``(asset, predicted_rul_days)``."""
    rul = F.col("predicted_rul_days")
    risk = risk_from_rul(rul)
    if is_proxy:
        text = F.format_string(
            "%s: %s risk, about %d days by wear. " + PROXY_NOTE, F.col(keys.id), risk, rul
        )
    else:
        text = F.format_string(
            "%s has predicted remaining useful life of %d days (%s risk). "
            "Treat as a model estimate, not a calendar failure date.",
            F.col(keys.id), rul, risk,
        )
    return days.select(
        keys.id, rul, text.alias("message"), risk.alias("risk_level"),
        F.lit(source).alias("label_source"), F.lit(is_proxy).alias("is_proxy"),
    )


def proxy_predictions(df: DataFrame, keys: Keys = Keys()) -> DataFrame:
    """Predictions straight from the proxy label of the newest row; no model."""
    newest = latest_per_asset(proxy_rul(df), ["proxy_rul"], keys)
    days = F.greatest(F.lit(1), F.bround("proxy_rul", 0).cast("int"))
    return predictions_table(
        newest.filter(F.col("proxy_rul").isNotNull()).select(keys.id, days.alias("predicted_rul_days")),
        True, "synthetic_degradation_proxy", keys,
    )


def label_predictions(df: DataFrame, keys: Keys = Keys()) -> DataFrame:
    """Per-asset life straight from the newest label, for the risk chart without a model."""
    newest = latest_per_asset(df, [LABEL], keys)
    rul = F.coalesce(F.col(LABEL), F.lit(0.0))
    return newest.select(
        keys.id, F.greatest(F.lit(1), F.bround(rul, 0).cast("int")).alias("predicted_rul_days"),
        risk_from_rul(rul).alias("risk_level"),
    )


# ---------------------------------------------------------------- search
def rul_space(max_trees: int = 250) -> dict:
    """Settings of random forests and boosted trees that are searched."""
    return {
        "RandomForest": {
            "trees": Axis(min(50, max_trees), max_trees, whole=True), "depth": Axis(3, 20, whole=True), "leaf": Axis(1, 6, whole=True),
        },
        "GradientBoosting": {
            "trees": Axis(min(50, max_trees), min(200, max_trees), whole=True), "depth": Axis(2, 8, whole=True), "rate": Axis(0.01, 0.3, log=True),
        },
    }


def _regressor(model: str, settings: dict, share: float, seed: int):
    trees = max(1, round(settings["trees"] * share))
    if model == "RandomForest":
        return RandomForestRegressor(
            numTrees=trees, maxDepth=settings["depth"], minInstancesPerNode=settings["leaf"], seed=seed, maxMemoryInMB=HISTOGRAM_MB,
        )
    return GBTRegressor(maxIter=trees, maxDepth=settings["depth"], stepSize=settings["rate"], seed=seed)


def tune_rul(
    featured: DataFrame,
    trials: int = 20,
    keys: Keys = Keys(),
    seed: int = RUL_SEED,
    folds: int | None = None,
    parallelism: int = 4,
    max_trees: int = 250,
) -> dict:
    """Best of ``trials`` settings by cross-validated RMSE, with its error on a held-out fifth and all evaluations.

    Proposals and early stopping are those of ``search``; a trial's share of effort is its share of trees.  Folds and
    the held-out fifth are by row hash, so they don't move with partitioning.
    """
    if LABEL not in featured.columns:
        raise ValueError(f"target {LABEL!r} not found")
    spark = featured.sparkSession
    names = feature_names(featured, keys)
    place = F.xxhash64(keys.id, keys.ts, keys.tie)
    rows = _assemble(featured.filter(F.col(LABEL).isNotNull()), names).select(
        "features", F.col(LABEL).cast("double").alias("label"), place.alias("place"), keys.id, keys.ts, keys.tie
    )
    rows = spread_rows(rows, keys.id, keys.ts, keys.tie)
    try:
        n = rows.count()
        if n < 30:
            raise ValueError("need at least 30 labelled rows")
        folds = folds or min(5, max(2, n // 20))
        fold = F.pmod(F.col("place"), F.lit(folds))

        def error(model: str, settings: dict, share: float) -> float:
            total = 0.0
            for k in range(folds):
                fitted = _regressor(model, settings, share, seed).fit(rows.filter(fold != k))
                total += regression_metrics(fitted.transform(rows.filter(fold == k)), digits=12)["rmse"]
            return total / folds

        history = search(
            rul_space(max_trees), error, trials, seed, side_by_side=parallelism, wrap=inheritable_thread_target(spark)
        )
        best = winner(history)
        part = F.pmod(F.shiftright("place", 8), F.lit(5))
        model = _regressor(best.model, best.settings, 1.0, seed).fit(rows.filter(part > 0))
        metrics = regression_metrics(model.transform(rows.filter(part == 0)), digits=4)
        return {
            "best_model": best.model, "best_params": best.settings, "rmse_cv": best.loss, "trials": trials, "features": names,
            "model": model, "history": history, **metrics,
        }
    finally:
        rows.unpersist()


def search_rows(spark, found: dict) -> DataFrame:
    """One row per evaluation: trial, model, settings, rung, RMSE, and whether it won."""
    top = winner(found["history"])
    rows = [
        (t.number, t.model, t.rung, t.settings["trees"], t.settings["depth"], t.settings.get("leaf"), t.settings.get("rate"),
         t.loss, t is top)
        for t in found["history"]
    ]
    return spark.createDataFrame(
        rows, "trial int, model string, rung int, trees int, depth int, leaf int, rate double, rmse_cv double, best boolean"
    )
