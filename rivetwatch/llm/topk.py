"""Exact top-k by inner product: vectors in order of length, rotated partial sums, Cauchy-Schwarz bounds.

Candidates lie in bands of descending length; a query is sent only to bands in which length alone could still beat the
k-th best score it has from the longest vectors.  Inside a block, vectors are walked by descending length.  Queries and
candidates are rotated onto the main axes of the candidates (a rotation keeps inner products), so the first few axes
carry most of a product; what the others can add is at most the product of the residual lengths.  Pairs whose partial
sum plus that bound is below the threshold are dropped, the rest get their exact integer product.

Work is dealt out as (block of queries, block of candidates); each pair of blocks sends at most k rows per query on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import stored

SCALE, EVERY, K = 256, 50, 5
BLOCK, QUERY_BLOCK, BANDS = 8192, 2048, 64
AXES_SAMPLE = 4096  # vectors from which the rotation is computed; it has no influence on results
HEAD_AXES = 0.25  # share of the axes in the partial sum
MAX_COMPONENT, LARGE_BLOCK = 1 << 25, 512
_STEP = 512


def prepared(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, v, norm, large: rows that can take part, ``v`` being the floor of ``scale`` times each component.

    Rows without vec_id, null vectors and vectors with a null or non-finite component (or one that
    overflows when scaled) take no part.  Where a scaled
    component reaches 2^25, so that products might not fit, ``v`` is null and ``large`` holds the whole numbers as doubles.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(scale * x.cast("double")) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
    fits = F.forall("embedding", lambda x: F.abs(x.cast("double")) < MAX_COMPONENT / scale)
    # From 2^52 on every double is whole, and ``floor`` would leave the range of a long.
    whole = F.transform("embedding", lambda x: F.when(F.abs(scale * x.cast("double")) < 2.0**52, F.floor(scale * x.cast("double")).cast("double")).otherwise(scale * x.cast("double")))
    small = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).cast("array<int>")
    rows = rows.select("vec_id", F.when(fits, small).alias("v"), F.when(~fits, whole).alias("large"))
    return rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x.cast("long") * x.cast("long")).cast("double")))


def _matrix(column: pa.ChunkedArray, width: int, kind: type = np.int64) -> np.ndarray:
    """Rows of a list column as ``kind``, with zeros up to ``width``."""
    values = column.combine_chunks()
    offsets, flat = np.asarray(values.offsets), np.asarray(values.values)
    lengths = np.diff(offsets)
    if len(lengths) and (lengths == width).all():
        return flat[offsets[0] : offsets[-1]].reshape(-1, width).astype(kind)
    out = np.zeros((len(lengths), width), kind)
    for i, (a, n) in enumerate(zip(offsets[:-1].tolist(), lengths.tolist())):
        out[i, :n] = flat[a : a + n]
    return out


def _products(q: np.ndarray, c: np.ndarray, safe: bool) -> np.ndarray:
    """Integer products; through floats where every sum is below 2^53 and so exact."""
    return (q.astype(float) @ c.astype(float).T).astype(np.int64) if safe else q @ c.T


class Best:
    """The k best (score, smaller vec_id first) of each query so far."""

    def __init__(self, queries: int, k: int, floor: np.ndarray):
        self.score = np.full((queries, k), np.iinfo(np.int64).min)
        self.vec = np.full((queries, k), np.iinfo(np.int64).max)
        self.floor = floor  # scores from elsewhere that k candidates reach

    def threshold(self) -> np.ndarray:
        return np.maximum(self.floor, self.score[:, -1].astype(float))

    def add(self, rows: np.ndarray, columns: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        k = self.score.shape[1]
        touched = np.unique(rows)
        r = np.concatenate([rows, np.repeat(touched, k)])
        s = np.concatenate([scores, self.score[touched].ravel()])
        v = np.concatenate([ids[columns], self.vec[touched].ravel()])
        order = np.lexsort((v, ~s, r))
        r, s, v = r[order], s[order], v[order]
        first = np.searchsorted(r, touched)
        take = first[:, None] + np.arange(k)
        self.score[touched], self.vec[touched] = s[take], v[take]


def search_block(q: np.ndarray, q_ids: np.ndarray, c: np.ndarray, c_ids: np.ndarray, axes: np.ndarray, k: int, floor: np.ndarray) -> Best:
    """The k best of ``c`` for each of ``q`` among those that reach ``floor``; own ids are no candidates."""
    best = Best(len(q), k, floor.astype(float))
    q_norm, c_norm = (np.sqrt((x.astype(float) ** 2).sum(axis=1)) for x in (q, c))
    order = np.lexsort((c_ids, -c_norm))
    c, c_ids, c_norm = c[order], c_ids[order], c_norm[order]
    safe = float(q_norm.max(initial=0) * c_norm.max(initial=0)) < 2**52
    head = max(1, int(len(axes) * HEAD_AXES))
    q_head, c_head = q @ axes[:, :head], c @ axes[:, :head]
    # Rounding can make a residual or a bound a little too small; the slack covers it.
    q_rest, c_rest = (np.sqrt(np.maximum(n**2 - (h**2).sum(axis=1), 0)) + 1e-6 * (n + 1) for n, h in ((q_norm, q_head), (c_norm, c_head)))
    for at in range(0, len(c), _STEP):
        limit = best.threshold()
        live = np.flatnonzero(q_norm * c_norm[at] * (1 + 1e-9) + 1e-6 >= limit)
        if not len(live):
            break
        part = slice(at, at + _STEP)
        bound = q_head[live] @ c_head[part].T + q_rest[live, None] * c_rest[None, part]
        open_ = (bound + 1e-9 * q_norm[live, None] * c_norm[None, part] + 1e-6 >= limit[live, None]) & (q_ids[live, None] != c_ids[None, part])
        rows, columns = np.nonzero(open_)
        if not len(rows):
            continue
        if len(rows) * 8 > open_.size:
            scores = _products(q[live], c[part], safe)[rows, columns]
        else:
            scores = np.einsum("ij,ij->i", q[live[rows]], c[part][columns])
        good = scores >= limit[live[rows]]
        best.add(live[rows[good]], columns[good], scores[good], c_ids[part]) if good.any() else None
    return best


def exact_best(q: np.ndarray, q_ids: np.ndarray, c: np.ndarray, c_ids: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(row of ``q``, id, score) of the k best, for whole numbers of any size held as doubles.

    Products in floating point, with their error bound, choose; Python's integers decide.  A score beyond a long counts
    as the nearest long.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        near = q @ c.T
        slack = (c.shape[1] + 2) * 2.0**-51 * (np.abs(q) @ np.abs(c).T)
        low, high = np.clip(near - slack, -(2.0**63), 2.0**63), np.clip(near + slack, -(2.0**63), 2.0**63)
    unsure = ~(np.isfinite(near) & np.isfinite(slack))
    low[unsure], high[unsure] = -(2.0**63), 2.0**63
    other = q_ids[:, None] != c_ids[None]
    low[~other] = -(2.0**63)
    out = []
    for i in range(len(q)):
        floor = np.partition(low[i], -k)[-k] if len(c) >= k else -(2.0**63)
        left = [int(x) for x in q[i]]
        scores = []
        for j in np.flatnonzero(other[i] & (high[i] >= floor)).tolist():
            s = sum(a * int(b) for a, b in zip(left, c[j].tolist()))
            scores.append((-min(max(s, -(1 << 63)), (1 << 63) - 1), int(c_ids[j])))
        out += [(i, vec, -s) for s, vec in sorted(scores)[:k]]
    return out


def _axes(vectors: DataFrame, width: int) -> np.ndarray:
    """Main axes of a bounded sample of the vectors, strongest first."""
    rows = vectors.select("v").orderBy(F.xxhash64("vec_id", "v")).limit(AXES_SAMPLE).toArrow()
    x = _matrix(rows.column(0), width).astype(float)
    _, _, axes = np.linalg.svd(x, full_matrices=True) if len(x) else (0, 0, np.eye(width))
    return axes.T


_FOUND = "qb int, pos int, query_id long, vec_id long, score long"


def top_k(vectors: DataFrame, every: int = EVERY, k: int = K, scale: int = SCALE) -> DataFrame:
    """For each row whose vec_id is divisible by ``every``: query_id, rank, vec_id, score of its k best candidates.

    Candidates are all rows with another vec_id; ties go to the smaller vec_id; fewer candidates give fewer rows.
    Repeated query rows are answered each, repeated candidates count each; vectors of unequal length are taken as
    padded with zeros; a score beyond a long counts as the nearest long; see ``prepared`` for rows that take no part.
    """
    every_row = stored(prepared(vectors, scale), "vectors")
    is_large = F.col("large").isNotNull()
    asks = F.col("vec_id") % every == 0
    width, queries, n, n_large = every_row.agg(
        F.max(F.greatest(F.size("v"), F.size("large"))), F.count_if(asks & ~is_large), F.count(F.lit(1)), F.count_if(is_large)).first()
    width = max(1, width or 1)
    rows = every_row.filter(~is_large).drop("large")
    best = Window.partitionBy("qb", "pos").orderBy(F.col("score").desc(), "vec_id")
    found, asked = _among_small(rows, every, k, queries, width)
    if n_large:
        found = found.unionByName(_with_large(every_row, asked, every, k, n, n_large, max(1, -(-queries // QUERY_BLOCK)), width))
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _with_large(every_row: DataFrame, asked: DataFrame, every: int, k: int, n: int, n_large: int, q_blocks: int, width: int) -> DataFrame:
    """Best candidates of pairs in which a vector has large components: those of the small queries among the large vectors,
    and those of the large queries among all.  Blocks of queries meet blocks of candidates; large vectors are few as a rule."""
    parts, q_parts = max(1, -(-n_large // LARGE_BLOCK)), max(1, -(-n // BLOCK))
    as_double = F.coalesce("large", F.col("v").cast("array<double>")).alias("x")
    spread = F.pmod(F.xxhash64("vec_id", "large", F.lit(7)), F.lit(parts)).cast("int")

    def numbers(n: int, first: int = 0):
        return F.explode(F.sequence(F.lit(first), F.lit(first + n - 1)))

    def search(_key, left: pa.Table, right: pa.Table) -> pa.Table:
        names, kinds = ("qb", "pos", "query_id", "vec_id", "score"), (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        found = []
        if left.num_rows and right.num_rows:
            q, c = _matrix(left["x"], width, float), _matrix(right["x"], width, float)
            ids = left["query_id"].to_numpy()
            for at in range(0, len(q), LARGE_BLOCK):
                part = slice(at, at + LARGE_BLOCK)
                found += [(at + i, vec, s) for i, vec, s in exact_best(q[part], ids[part], c, right["vec_id"].to_numpy(), k)]
        row = np.array([f[0] for f in found], np.int64)
        columns = [left[name].to_numpy()[row] for name in names[:3]] + [[f[1] for f in found], [f[2] for f in found]]
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=list(names))

    large = every_row.filter(F.col("large").isNotNull())
    # Large queries are numbered behind the blocks of small ones.
    place = Window.partitionBy("qb").orderBy("vec_id", F.xxhash64("large"))
    of_large = large.filter(F.col("vec_id") % every == 0).withColumn("qb", spread + F.lit(q_blocks))
    of_large = of_large.select("qb", (F.row_number().over(place) - 1).alias("pos"), F.col("vec_id").alias("query_id"), as_double)
    all_parts = F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(q_parts)).cast("int")
    pairs = [
        (asked.select("qb", "pos", "query_id", F.col("v").cast("array<double>").alias("x"), numbers(parts).alias("part")),
         large.select(spread.alias("part"), "vec_id", as_double, numbers(q_blocks).alias("qb"))),
        (of_large.select("*", numbers(q_parts).alias("part")),
         every_row.select(all_parts.alias("part"), "vec_id", as_double, numbers(parts, q_blocks).alias("qb"))),
    ]
    first, second = (q.groupBy("qb", "part").cogroup(c.groupBy("qb", "part")).applyInArrow(search, _FOUND) for q, c in pairs)
    return first.unionByName(second)


def _among_small(rows: DataFrame, every: int, k: int, queries: int, width: int) -> tuple[DataFrame, DataFrame]:
    """Rows of ``_FOUND`` with every query's k best, and the table of queries, of vectors without large components."""
    spark = rows.sparkSession
    if not queries:
        return spark.createDataFrame([], _FOUND), spark.createDataFrame([], "qb int, pos int, query_id long, v array<int>")
    q_blocks = max(1, -(-queries // QUERY_BLOCK))
    cuts = rows.agg(F.percentile_approx("norm", [i / BANDS for i in range(1, BANDS)], 10_000)).first()[0] or []
    cuts = sorted({float(c) for c in cuts}, reverse=True)
    band = F.lit(0)
    for c in cuts:  # at most BANDS
        band = band + (F.col("norm") < c).cast("int")
    rows = rows.withColumn("band", band)
    sizes = {r.band: (r.n, r.top) for r in rows.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("top")).collect()}
    # Bands are cut into blocks by a hash, so equal or repeated vectors spread as well.
    parts = {b: max(1, round(m / BLOCK)) for b, (m, _) in sizes.items()}
    per_band = F.lit(1)
    for b, p in parts.items():
        per_band = F.when(F.col("band") == b, p).otherwise(per_band)
    block = F.pmod(F.xxhash64("vec_id", F.lit(7)), per_band).cast("int")
    candidates = rows.withColumn("part", block)
    shared = spark.sparkContext.broadcast(_axes(rows, width))  # width x width numbers

    place = Window.partitionBy("qb").orderBy("vec_id", F.xxhash64("v"))  # at most about QUERY_BLOCK rows
    asked = rows.filter(F.col("vec_id") % every == 0).withColumn("qb", F.pmod(F.xxhash64("vec_id", F.lit(11)), F.lit(q_blocks)).cast("int"))
    asked = stored(asked.select("qb", (F.row_number().over(place) - 1).alias("pos"), F.col("vec_id").alias("query_id"), "v", "norm"), "queries")

    def search(_key, left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({f: [] for f in ("qb", "pos", "query_id", "vec_id", "score")}).cast(
            pa.schema([("qb", pa.int32()), ("pos", pa.int32()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())]))
        if not left.num_rows or not right.num_rows:
            return empty
        q, c = _matrix(left["v"], width), _matrix(right["v"], width)
        ids = left["query_id"].to_numpy()
        best = search_block(q, ids, c, right["vec_id"].to_numpy(), shared.value, k, left["floor"].to_numpy())
        r, j = np.nonzero(best.vec != np.iinfo(np.int64).max)
        return pa.table([pa.array(left["qb"].to_numpy()[r], pa.int32()), pa.array(left["pos"].to_numpy()[r], pa.int32()), pa.array(ids[r]),
                         pa.array(best.vec[r, j]), pa.array(best.score[r, j])], names=empty.column_names)

    def pairs(queries_: DataFrame, rows_: DataFrame, keys: list[str]) -> DataFrame:
        return queries_.groupBy(*keys).cogroup(rows_.groupBy(*keys)).applyInArrow(search, _FOUND)

    best = Window.partitionBy("qb", "pos").orderBy(F.col("score").desc(), "vec_id")
    q_ids = F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("qb")
    # A first look at one block of the longest vectors gives every query a score that k candidates reach.
    head = candidates.filter((F.col("band") == min(sizes)) & (F.col("part") == 0)).select(q_ids, "vec_id", "v")
    low = F.lit(float(np.finfo(float).min))
    seen = pairs(asked.withColumn("floor", low), head, ["qb"]).withColumn("r", F.row_number().over(best)).filter(F.col("r") == k)
    seen = seen.select("qb", "pos", F.col("score").cast("double").alias("floor"))
    known = stored(asked.join(seen, ["qb", "pos"], "left").withColumn("floor", F.coalesce("floor", low)), "queries")

    # Which bands can matter to a query, and to any query of a block: by length alone.
    tops = F.array(*[F.struct(F.lit(b).alias("band"), F.lit(float(t) * (1 + 1e-9) + 1e-6).alias("top"), F.lit(parts[b]).alias("parts")) for b, (_, t) in sorted(sizes.items())])
    reached = F.filter(tops, lambda t: F.col("norm") * t["top"] + 1e-6 >= F.col("floor"))
    sent = known.withColumn("t", F.explode(reached)).select("*", F.col("t.band").alias("band"), F.explode(F.sequence(F.lit(0), F.col("t.parts") - 1)).alias("part"))
    wanted = {(r.qb, r.band) for r in sent.select("qb", "band").distinct().collect()}  # query blocks x bands
    deal = F.lit(None).cast("array<int>")
    for b in sizes:
        blocks = sorted(q for q, bb in wanted if bb == b)
        deal = F.when(F.col("band") == b, F.array(*map(F.lit, blocks)) if blocks else F.lit(None).cast("array<int>")).otherwise(deal)
    copies = candidates.select("band", "part", "vec_id", "v", F.explode(deal).alias("qb"))
    found = pairs(sent.select("qb", "band", "part", "pos", "query_id", "v", "floor"), copies, ["qb", "band", "part"])
    return found, asked


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM pairs QUALIFY rank <= 5
"""
