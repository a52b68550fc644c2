"""Isolation forest: bounded distributed sample, trees grown per group, vectorised scoring.

Training cost does not grow with the table: every tree sees at most 256 rows.
Rows are drawn by hash, so the same rows are drawn under any partitioning.
Scores follow the published definition ``2 ** (-E[path] / c(sample))``; they are
not bit-equal to another library's forest, whose random numbers differ.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..constants import ANOMALY_CONTAMINATION, FOREST_TREES, RUL_SEED
from ..functions.columns import Keys, as_double, model_features
from ..functions.quantiles import quantiles
from ..session import kept

SAMPLE_ROWS = 256
_TREE_SCHEMA = "tree int, feature array<int>, cut array<double>, left array<int>, right array<int>, path array<double>"


def average_path(m) -> float:
    """Mean path length of an unsuccessful search in a tree of ``m`` points."""
    if m <= 1:
        return 0.0
    if m == 2:
        return 1.0
    return 2.0 * (math.log(m - 1.0) + np.euler_gamma) - 2.0 * (m - 1.0) / m


@dataclass(frozen=True)
class ForestModel:
    """A trained forest: at most trees x 511 nodes, small enough to travel with the task."""

    features: tuple
    fill: tuple
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    path: np.ndarray
    depth: int
    sample: int
    threshold: float | None
    contamination: float

    def score(self, df: DataFrame) -> Column:
        """Score column for a batch or streaming table (higher = more anomalous)."""
        inputs = [F.coalesce(as_double(df, c), F.lit(m)) for c, m in zip(self.features, self.fill)]
        return _scorer(self)(*inputs)

    def annotate(self, df: DataFrame) -> DataFrame:
        """Add ``anomaly_score`` and ``is_anomaly``."""
        out = df.withColumn("anomaly_score", self.score(df))
        return out.withColumn("is_anomaly", F.col("anomaly_score") > F.lit(self.threshold))


def _scorer(model: ForestModel):
    norm = average_path(model.sample)
    arrays = (model.feature, model.cut, model.left, model.right, model.path)

    @F.pandas_udf(T.DoubleType())
    def score(*cols: pd.Series) -> pd.Series:
        feature, cut, left, right, path = arrays
        x = np.column_stack([c.to_numpy(dtype="float64") for c in cols])
        rows = np.arange(len(x))
        total = np.zeros(len(x))
        for t in range(len(feature)):
            node = np.zeros(len(x), dtype=np.int32)
            for _ in range(model.depth):
                # Leaves point at themselves, so extra steps change nothing.
                low = x[rows, feature[t][node]] < cut[t][node]
                node = np.where(low, left[t][node], right[t][node])
            total += path[t][node]
        return pd.Series(2.0 ** (-(total / len(feature)) / norm))

    return score


def _grow(sample: np.ndarray, rng: np.random.Generator, limit: int):
    """One isolation tree as flat node lists."""
    feature, cut, left, right, path = [], [], [], [], []

    def node(points: np.ndarray, depth: int) -> int:
        at = len(feature)
        feature.append(0), cut.append(0.0), left.append(at), right.append(at)
        path.append(depth + average_path(len(points)))
        low, high = points.min(axis=0), points.max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(points) < 2 or len(usable) == 0:
            return at
        pick = int(rng.choice(usable))
        at_value = float(rng.uniform(low[pick], high[pick]))
        below = points[:, pick] < at_value
        if not below.any() or below.all():
            at_value = float(np.nextafter(low[pick], high[pick]))
            below = points[:, pick] < at_value
        feature[at], cut[at] = pick, at_value
        left[at] = node(points[below], depth + 1)
        right[at] = node(points[~below], depth + 1)
        return at

    node(sample, 0)
    return feature, cut, left, right, path


def _draw(df: DataFrame, tie: str, n: int, trees: int, sample: int, seed: int) -> DataFrame:
    """At most ``sample`` rows per tree, drawn alike whatever the size of the table.

    One hash places a row on a circle, the trees stand evenly around it, and a row is drawn by the trees in the arc
    before it.  The arc's length makes about twice ``sample`` candidates per tree (all rows of a small table), of
    which a second hash keeps the first ``sample``.  So a row of a large table meets one tree at most.
    """
    share = min(1.0, 2.0 * sample / max(n, 1))
    place = F.pmod(F.xxhash64(tie, F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40)) * trees
    first = F.ceil(place - share * trees)
    arc = F.when(F.lit(share >= 1.0), F.sequence(F.lit(0), F.lit(trees - 1))).otherwise(
        F.when(F.ceil(place) > first, F.transform(F.sequence(first, F.ceil(place) - 1), lambda t: F.pmod(t, F.lit(trees)).cast("int"))))
    drawn = df.withColumn("tree", F.explode(arc))
    w = Window.partitionBy("tree").orderBy(F.xxhash64(tie, "tree", F.lit(seed)), tie)
    return drawn.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= sample).drop("__rn")


def fit_forest(
    df: DataFrame,
    features: list[str] | None = None,
    contamination: float = ANOMALY_CONTAMINATION,
    trees: int = FOREST_TREES,
    sample: int = SAMPLE_ROWS,
    seed: int = RUL_SEED,
    keys: Keys = Keys(),
    with_threshold: bool = True,
) -> ForestModel:
    """Train on a bounded sample; the threshold is the exact ``1 - contamination`` quantile of all scores."""
    if not 0 < contamination <= 0.5:
        raise ValueError("contamination must be in (0, 0.5]")
    features = features or model_features(df, keys)
    if not features:
        raise ValueError("no numeric sensor columns to train on")
    typed = df.select(keys.tie, *[as_double(df, c).alias(c) for c in features])
    n = typed.count()
    if n == 0:
        raise ValueError("no rows to train on")
    medians = quantiles(typed, features, [0.5], group_rows=n).first()
    fill = tuple(float(medians[c][0]) if medians[c] and medians[c][0] is not None else 0.0 for c in features)
    filled = typed.select(keys.tie, *[F.coalesce(F.col(c), F.lit(m)).alias(c) for c, m in zip(features, fill)])

    size = min(sample, n)
    limit = max(1, math.ceil(math.log2(max(size, 2))))
    names = list(features)

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        tree = int(group["tree"].iloc[0])
        points = group.sort_values(keys.tie)[names].to_numpy(dtype="float64")
        parts = _grow(points, np.random.default_rng([seed, tree]), limit)
        return pd.DataFrame(
            [[tree, *parts]], columns=["tree", "feature", "cut", "left", "right", "path"]
        )

    grown = _draw(filled, keys.tie, n, trees, size, seed).groupBy("tree").applyInPandas(grow, _TREE_SCHEMA)
    rows = sorted(grown.collect(), key=lambda r: r["tree"])  # at most ``trees`` rows of <= 511 nodes
    nodes = max(len(r["feature"]) for r in rows)

    def stack(part, dtype):
        return np.array([list(r[part]) + [0] * (nodes - len(r[part])) for r in rows], dtype=dtype)

    model = ForestModel(
        tuple(features), fill, stack("feature", "int32"), stack("cut", "float64"), stack("left", "int32"),
        stack("right", "int32"), stack("path", "float64"), limit, size, None, contamination,
    )
    if not with_threshold:
        return model
    return _with_bar(model, kept(df.select(model.score(df).alias("anomaly_score")), "scores"), n)


def _with_bar(model: ForestModel, scores: DataFrame, n: int) -> ForestModel:
    bar = quantiles(scores, ["anomaly_score"], [1 - model.contamination], group_rows=n).first()["anomaly_score"][0]
    return replace(model, threshold=float(bar))


def fit_annotate(
    df: DataFrame, features: list[str] | None = None, contamination: float = ANOMALY_CONTAMINATION, **options
) -> tuple[ForestModel, DataFrame]:
    """``fit_forest`` and ``annotate`` with one pass of the forest: scores are written once, then ranked and flagged."""
    model = fit_forest(df, features, contamination, with_threshold=False, **options)
    scored = kept(df.withColumn("anomaly_score", model.score(df)), "scored")
    model = _with_bar(model, scored, scored.count())
    return model, scored.withColumn("is_anomaly", F.col("anomaly_score") > F.lit(model.threshold))


def anomaly_summary(scored: DataFrame) -> DataFrame:
    flagged = F.count_if("is_anomaly")
    return scored.agg(
        F.count(F.lit(1)).alias("total_records"),
        flagged.alias("anomaly_count"),
        F.bround(100.0 * flagged / F.greatest(F.count(F.lit(1)), F.lit(1)), 2).alias("anomaly_rate_pct"),
        F.bround(F.avg("anomaly_score"), 4).alias("score_mean"),
        F.bround(F.max("anomaly_score"), 4).alias("score_max"),
    )


def anomaly_rates(scored: DataFrame, keys: Keys = Keys()) -> DataFrame:
    return scored.groupBy(keys.id).agg(
        F.bround(F.avg(F.col("is_anomaly").cast("double")) * 100, 2).alias("anomaly_rate_pct")
    )


def tune_contamination(scored: DataFrame, candidates: list[float] | None = None, rows: int | None = None) -> DataFrame:
    """Gap between mean score above and below each candidate threshold, best first.

    Scores do not depend on the contamination, so one scored table serves all candidates.
    """
    candidates = candidates or [0.02 + 0.01 * i for i in range(14)]
    probs = [1 - c for c in candidates]
    bars = quantiles(scored, ["anomaly_score"], probs, group_rows=rows).select(F.col("anomaly_score").alias("__bars"))
    s, out = F.col("anomaly_score"), []
    for i, c in enumerate(candidates):
        bar = F.col("__bars")[i]
        gap = F.avg(F.when(s >= bar, s)) - F.avg(F.when(s < bar, s))
        out.append(F.struct(F.lit(float(c)).alias("contamination"), gap.alias("separation")))
    row = scored.crossJoin(F.broadcast(bars)).agg(F.array(*out).alias("r"))
    return row.select(F.explode("r").alias("r")).select("r.*").orderBy(F.col("separation").desc_nulls_last(), "contamination")
