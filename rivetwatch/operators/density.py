"""DBSCAN over a whole table, block against block.

Points are standardised, copies become one weighted point, and the points are
cut into compact blocks: first into regions by medians of a hashed sample (it
only places the cuts), then inside a region by exact medians, until a block
has at most ``BLOCK`` points or lies within ``eps`` as a whole.  So where data
are dense, the number of blocks follows their spread and not the number of
rows.  A block settles most questions by itself.  What it leaves open
is asked of the blocks whose boxes come within ``eps``: sparse points look for
more neighbours, points that aren't core for a core point, and parts of blocks
for other parts to join.  Only such points travel, packed by block, and pairs
of blocks meet by pairs of regions, so no step makes a row per pair of points.

Parts ask their nearest parts first; parts already in one cluster never meet.
Distances come from matrix products; those too close to ``eps`` to tell are
taken again from the differences, so the answer is exact.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import Keys, numeric_columns
from ..session import checkpoint_dir, kept

BLOCK, _SLICE = 512, 4096  # points compared at once
REGION = 8192  # points of a region as the sample foresees them
_REGIONS, _SAMPLE = 8192, 32  # most regions, sampled points for each
_NODE = 1 << 32  # points of a region stay below
_NEAREST = 8  # parts that a part meets in the first round


def _near(d: int, a: str, b: str) -> Column:
    """Smallest squared distance between two boxes ``<p>lo .. <p>hi``."""
    return F.expr(" + ".join(
        f"pow(greatest(0D, {a}lo[{i}] - {b}hi[{i}], {b}lo[{i}] - {a}hi[{i}]), 2)" for i in range(d)
    ))


def _far(d: int, a: str, b: str) -> Column:
    """Largest squared distance between two boxes."""
    return F.expr(" + ".join(
        f"pow(greatest(abs({a}hi[{i}] - {b}lo[{i}]), abs({b}hi[{i}] - {a}lo[{i}])), 2)" for i in range(d)
    ))


def _middles(d: int, a: str, b: str) -> Column:
    """Squared distance between the middles of two boxes, times four."""
    return F.expr(" + ".join(f"pow({a}lo[{i}] + {a}hi[{i}] - {b}lo[{i}] - {b}hi[{i}], 2)" for i in range(d)))


# ---------------------------------------------------------------- inside a task
def _points(flat, d: int) -> np.ndarray:
    return np.asarray(flat, dtype=float).reshape(-1, d)


def _within(a: np.ndarray, b: np.ndarray, eps2: float) -> np.ndarray:
    """Which points of ``a`` and ``b`` lie within eps."""
    mid = a.mean(0)
    p, q = a - mid, b - mid
    pp, qq = (p * p).sum(1), (q * q).sum(1)
    d2 = pp[:, None] + qq - 2 * (p @ q.T)
    slack = 1e-14 * (a.shape[1] + 8) * (pp.max() + qq.max() + eps2)
    i, j = np.nonzero(np.abs(d2 - eps2) <= slack)
    near = d2 <= eps2
    near[i, j] = ((a[i] - b[j]) ** 2).sum(1) <= eps2
    return near


def _any_within(a: np.ndarray, b: np.ndarray, eps2: float) -> bool:
    return any(_within(a[i:i + BLOCK], b[j:j + _SLICE], eps2).any() for i in range(0, len(a), BLOCK) for j in range(0, len(b), _SLICE))


def _tight(x: np.ndarray, eps2: float) -> bool:
    """Whether all points see each other because their box is that small."""
    return bool(((x.max(0) - x.min(0)) ** 2).sum() <= eps2)


def _in_reach(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, eps2: float) -> np.ndarray:
    """Which points lie within eps of a box."""
    return (np.maximum(0, np.maximum(lo - x, x - hi)) ** 2).sum(1) <= eps2 * (1 + 1e-9)


def _blocks_of(x: np.ndarray, size: int, eps2: float) -> list[np.ndarray]:
    """Row numbers of compact blocks: halves by the median along the longest side."""
    out, todo = [], [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        own = x[rows]
        if len(rows) <= size or _tight(own, eps2):
            out.append(rows)
            continue
        axis, half = int(np.argmax(own.max(0) - own.min(0))), len(rows) // 2
        order = np.argpartition(own[:, axis], half)
        todo += [rows[order[:half]], rows[order[half:]]]
    return out


def _parts(near: np.ndarray) -> np.ndarray:
    """Of points with their links: the smallest number of each point's connected part."""
    label = np.full(len(near), -1)
    for start in range(len(near)):
        if label[start] < 0:
            front = np.zeros(len(near), bool)
            front[start] = True
            while front.any():
                label[front] = start
                front = near[front].any(0) & (label < 0)
    return label


def _cuts(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """A full binary tree over a sample: axis and place of the cut of every inner node."""
    axis, cut = np.zeros(2**depth - 1, int), np.full(2**depth - 1, np.inf)
    sets = [sample]
    for node in range(len(axis)):
        own = sets[node]
        sets[node] = None
        left = right = own
        if len(own) > 1:
            axis[node] = k = int(np.argmax(own.max(0) - own.min(0)))
            v = np.sort(own[:, k])
            at = v[(len(v) - 1) // 2]
            if at == v[-1] and v[0] < v[-1]:
                at = v[v < v[-1]][-1]
            cut[node] = at
            left, right = own[own[:, k] <= at], own[own[:, k] > at]
        sets += [left, right]
    return axis, cut


# ---------------------------------------------------------------- tables
class _Blocks:
    """Standardised points in blocks, and which blocks come within eps of each other."""

    def __init__(self, df: DataFrame, cols: list[str], eps: float, min_pts: int, block: int | None = None, region: int | None = None):
        self.d, self.eps2, self.min_pts = len(cols), eps * eps * (1 + 1e-12), min_pts
        self.size, self.region = block or BLOCK, region or REGION
        row = df.agg(
            *[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)]
        ).first()
        x = F.array(*[
            (F.col(c).cast("double") - F.lit(float(row[f"m{i}"] or 0.0))) / F.lit(float(row[f"s{i}"] or 1.0)) for i, c in enumerate(cols)
        ])
        # Identical points become one weighted point as early as the map side.
        self.points = kept(df.select(x.alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("w")), "dbscan-points")
        self.blocks = kept(self._blocks(), "dbscan-blocks")
        self.pairs = kept(self._neighbours(), "dbscan-pairs")

    def _blocks(self) -> DataFrame:
        """Blocks with tight boxes, their points, weights, and the weight each point sees inside its block."""
        d, eps2, size, least = self.d, self.eps2, self.size, self.min_pts
        n = self.points.count()
        depth = max(0, math.ceil(math.log2(min(_REGIONS, max(1, n / self.region)))))
        part = min(1.0, _SAMPLE * 2**depth / max(1, n))
        sample = self.points.filter(F.pmod(F.xxhash64("x"), F.lit(1 << 30)) < int(part * (1 << 30)) + 1).select("x").toArrow() if depth else None
        axis, cut = _cuts(_points(sample["x"].combine_chunks().flatten(), d), depth) if depth else (np.zeros(0, int), np.zeros(0))

        def place(batches):
            for batch in batches:
                x = _points(batch.column("x").flatten(), d)
                node = np.zeros(len(x), int)
                for _ in range(depth):
                    node = 2 * node + 1 + (x[np.arange(len(x)), axis[node]] > cut[node])
                yield pa.RecordBatch.from_arrays([pa.array(node - (2**depth - 1), pa.int64()), batch.column("x"), batch.column("w")], ["region", "x", "w"])

        def build(table: pa.Table) -> pa.Table:
            x, w = _points(table["x"].combine_chunks().flatten(), d), table["w"].to_numpy()
            region, out, start = table["region"][0].as_py(), [], 0
            for rows in _blocks_of(x, size, eps2):
                own, weight = x[rows], w[rows]
                if _tight(own, eps2):
                    seen = np.full(len(own), weight.sum())
                else:
                    seen = (_within(own, own, eps2) | np.eye(len(own), dtype=bool)) @ weight
                seen, block = np.minimum(seen, least), region * _NODE + start
                start += len(own)
                out.append({
                    "region": region, "block": block, "lo": own.min(0), "hi": own.max(0), "x": own.ravel(), "w": weight, "got": seen,
                })
            return pa.Table.from_pylist(out, schema=schema)

        doubles, longs = pa.list_(pa.float64()), pa.list_(pa.int64())
        schema = pa.schema([("region", pa.int64()), ("block", pa.int64()), ("lo", doubles), ("hi", doubles), ("x", doubles), ("w", longs), ("got", longs)])
        placed = self.points.mapInArrow(place, "region long, x array<double>, w long")
        return placed.groupBy("region").applyInArrow(
            build, "region long, block long, lo array<double>, hi array<double>, x array<double>, w array<long>, got array<long>"
        )

    def _neighbours(self) -> DataFrame:
        """Ordered pairs (a, b) of different blocks whose boxes come within eps, found by pairs of regions."""
        boxes = self.blocks.select("region", "block", "lo", "hi")
        whole = boxes.groupBy("region").agg(*[
            F.array(*[f(F.expr(f"{n}[{i}]")) for i in range(self.d)]).alias(n) for n, f in (("lo", F.min), ("hi", F.max))
        ])
        side = [whole.select(F.col("region").alias(f"{s}region"), F.col("lo").alias(f"{s}lo"), F.col("hi").alias(f"{s}hi")) for s in "ab"]
        front = side[0].crossJoin(F.broadcast(side[1])).filter(_near(self.d, "a", "b") <= self.eps2).select("aregion", "bregion")  # at most 8,192 regions
        for s in "ab":
            own = boxes.select(F.col("region").alias(f"{s}region"), F.col("block").alias(s), F.col("lo").alias(f"{s}lo"), F.col("hi").alias(f"{s}hi"))
            front = front.join(own, f"{s}region")
        return front.filter("a <> b").filter(_near(self.d, "a", "b") <= self.eps2).select("a", "b", "aregion", "bregion")

    def meet(self, pairs: DataFrame, left: DataFrame, right: DataFrame, judge, schema: str) -> DataFrame:
        """``judge`` on what the pairs' left and right blocks bring along, region by region."""
        sides = [
            t.join(pairs.select(F.col(s).alias("block"), F.col("aregion").alias(f"{s}_from"), F.col("bregion").alias(f"{s}_to")).distinct(), "block")
            .groupBy(f"{s}_from", f"{s}_to") for s, t in (("a", left), ("b", right.toDF(*right.columns)))
        ]
        return sides[0].cogroup(sides[1]).applyInArrow(judge, schema)

    def of_some(self, blocks: DataFrame, wanted: str, *more: str) -> DataFrame:
        """Only the points that ``wanted`` (of number i) names, with their numbers; their box is tight."""
        picked = blocks.withColumn("at", F.expr(f"filter(sequence(0, size(w) - 1), i -> {wanted})")).filter("size(at) > 0")
        d = self.d
        x = F.expr(f"flatten(transform(at, i -> slice(x, i * {d} + 1, {d})))")
        ends = [F.expr("array(" + ", ".join(f"{f}(transform(at, i -> px[i * {d} + {k}]))" for k in range(d)) + ")") for f in ("array_min", "array_max")]
        picked = picked.withColumnRenamed("x", "px").withColumns({"lo": ends[0], "hi": ends[1]}).withColumnRenamed("px", "x")
        return picked.select("block", "at", "lo", "hi", x.alias("x"), *[F.expr(f"transform(at, i -> {c}[i])").alias(c) for c in more])


def _opened(table: pa.Table, d: int, *names: str) -> list[dict]:
    """Rows of a table of blocks with their arrays as numpy arrays."""
    cols = {n: [np.asarray(v.values) for v in table[n]] for n in ("at", "x", "lo", "hi", *names)}
    return [
        {"block": b, **{n: cols[n][i] for n in cols}, "x": cols["x"][i].reshape(-1, d)} for i, b in enumerate(table["block"].to_pylist())
    ]


def _near_boxes(row: dict, others: list[dict], lo: np.ndarray, hi: np.ndarray, eps2: float):
    """The other blocks of which something may lie within eps of a block."""
    gap = (np.maximum(0, np.maximum(lo - row["hi"], row["lo"] - hi)) ** 2).sum(1)
    return [others[k] for k in np.flatnonzero(gap <= eps2 * (1 + 1e-9)) if others[k]["block"] != row["block"]]


def _met(g: _Blocks, pairs: DataFrame, left: DataFrame, right: DataFrame, of_right: str | None) -> DataFrame:
    """(block, at, more): left points that see something on the right, and the weight, or the number, they see."""
    d, eps2 = g.d, g.eps2
    schema = pa.schema([("block", pa.int64()), ("at", pa.int32()), ("more", pa.int64())])

    def judge(a: pa.Table, b: pa.Table) -> pa.Table:
        out = []
        if a.num_rows and b.num_rows:
            others = _opened(b, d, *([of_right] if of_right else []))
            lo, hi = np.stack([o["lo"] for o in others]), np.stack([o["hi"] for o in others])
            for row in _opened(a, d):
                seen = np.zeros(len(row["at"]), int)
                for o in _near_boxes(row, others, lo, hi, eps2):
                    close = np.flatnonzero(_in_reach(row["x"], o["lo"], o["hi"], eps2))
                    for j in range(0, len(o["x"]) if len(close) else 0, _SLICE):
                        near = _within(row["x"][close], o["x"][j:j + _SLICE], eps2)
                        seen[close] += near @ o[of_right][j:j + _SLICE] if of_right else near.any(1)
                hit = np.flatnonzero(seen)
                out.append(pa.table([np.full(len(hit), row["block"]), row["at"][hit], seen[hit]], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    found = g.meet(pairs, left, right, judge, "block long, at int, more long")
    return found.groupBy("block", "at").agg(F.sum("more").alias("more"))


def _facing(g: _Blocks, left: DataFrame, right: DataFrame) -> DataFrame:
    """Neighbouring pairs in which something of the left block lies within eps of the right one."""
    sides = [t.select(F.col("block").alias(s), F.col("lo").alias(f"{s}lo"), F.col("hi").alias(f"{s}hi")) for s, t in (("a", left), ("b", right))]
    return g.pairs.join(sides[0], "a").join(sides[1], "b").filter(_near(g.d, "a", "b") <= g.eps2).select("a", "b", "aregion", "bregion")


def _with_cores(g: _Blocks) -> DataFrame:
    """Blocks with core marks, ``part`` (smallest number of a core point's part in its block), and points a core of the block holds."""
    sparse = kept(g.of_some(g.blocks, f"got[i] < {g.min_pts}"), "dbscan-sparse")
    whole = g.blocks.select("block", "lo", "hi", F.expr("sequence(0, size(w) - 1)").alias("at"), "x", "w")
    more = _met(g, _facing(g, sparse, whole), sparse, whole, "w").groupBy("block").agg(F.collect_list(F.struct("at", "more")).alias("more"))
    d, eps2, least = g.d, g.eps2, g.min_pts

    def judge(batches):
        for batch in batches:
            parts, held, marks = [], [], []
            for x, got, extra in zip(batch["x"], batch["got"], batch["more"], strict=True):
                x, got = _points(x.values, d), np.array(got.values)
                for m in extra.as_py() or []:
                    got[m["at"]] += m["more"]
                core = got >= least
                part, reached = np.full(len(x), -1), np.zeros(len(x), bool)
                mine = np.flatnonzero(core)
                if len(mine) and _tight(x, eps2):
                    reached[:], part[mine] = True, mine[0]
                elif len(mine):
                    near = _within(x, x[mine], eps2)
                    reached = near.any(1)
                    part[mine] = mine[_parts(near[mine])]
                marks.append(core)
                parts.append(part)
                held.append(reached | core)
            arrays = [batch[n] for n in ("region", "block", "x", "w")]
            arrays += [pa.array(marks, pa.list_(pa.bool_())), pa.array(held, pa.list_(pa.bool_())), pa.array(parts, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, ["region", "block", "x", "w", "core", "held", "part"])

    joined = g.blocks.select("region", "block", "x", "w", "got").join(more, "block", "left").select("region", "block", "x", "w", "got", "more")
    return joined.mapInArrow(judge, "region long, block long, x array<double>, w array<long>, core array<boolean>, held array<boolean>, part array<int>")


def _touching(g: _Blocks, pairs: DataFrame, cores: DataFrame) -> DataFrame:
    """Pairs (a, b) of parts with at least one core point of each within eps; a part's block is its number up to the block's size."""
    d, eps2 = g.d, g.eps2
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def judge(a: pa.Table, b: pa.Table) -> pa.Table:
        out = []
        if a.num_rows and b.num_rows:
            others = {o["block"]: o for o in _opened(b, d, "part")}
            for row, asks in zip(_opened(a, d, "part"), a["asks"], strict=True):
                for ask in asks.as_py():
                    if (o := others.get(ask["block"])) is None:
                        continue  # a block of another region
                    x, y = row["x"][row["part"] == ask["a"] - row["block"]], o["x"][o["part"] == ask["b"] - ask["block"]]
                    x = x[_in_reach(x, y.min(0), y.max(0), eps2)]
                    y = y[_in_reach(y, row["lo"], row["hi"], eps2)]
                    if len(x) and len(y) and _any_within(x, y, eps2):
                        out.append((ask["a"], ask["b"]))
        return pa.table([[p[i] for p in out] for i in (0, 1)], schema=schema)

    asks = pairs.groupBy(F.col("ablock").alias("block")).agg(F.collect_list(F.struct(F.col("bblock").alias("block"), "a", "b")).alias("asks"))
    met = pairs.select(F.col("ablock").alias("a"), F.col("bblock").alias("b"), "aregion", "bregion")
    return g.meet(met, cores.join(asks, "block"), cores, judge, "a long, b long")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, label): the smallest id of each connected part, by neighbour minimum and label jumping."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().persist()
    labels = nodes.select("id", F.col("id").alias("label")).checkpoint()
    while True:
        lower = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("label").alias("low"))
        step = labels.join(lower, labels["id"] == lower["a"], "left").select("id", F.least("label", "low").alias("label"), F.col("label").alias("old"))
        roots = step.select(F.col("id").alias("root"), F.col("label").alias("higher"))
        jumped = step.join(roots, step["label"] == roots["root"]).select("id", F.least("label", "higher").alias("label"), "old").checkpoint()
        if jumped.filter("label <> old").isEmpty():
            return jumped.select("id", "label")
        labels = jumped.select("id", "label")


def _clusters(g: _Blocks, cores: DataFrame) -> DataFrame:
    """(id, label) of the parts: parts ask their nearest parts first, in rounds with more of them, until none are left apart."""
    d, names = g.d, ["id", "block", "lo", "hi"]

    def boxes(batches):
        for batch in batches:
            out = []
            for block, x, part in zip(batch["block"].to_pylist(), batch["x"], batch["part"], strict=True):
                x, part = _points(x.values, d), np.asarray(part.values)
                order = np.argsort(part, kind="stable")
                starts = np.flatnonzero(np.diff(part[order], prepend=-1))
                ends = [f.reduceat(x[order], starts, axis=0) for f in (np.minimum, np.maximum)]
                out += [(block + int(part[order[at]]), block, ends[0][k], ends[1][k]) for k, at in enumerate(starts)]
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names)

    found = cores.select("block", "x", "part").mapInArrow(boxes, "id long, block long, lo array<double>, hi array<double>")
    parts = kept(found, "dbscan-parts")
    labels = parts.select("id", F.col("id").alias("label"))
    pairs = g.pairs.filter("a < b").withColumnsRenamed({"a": "ablock", "b": "bblock"})
    for s in "ab":
        pairs = pairs.join(parts.select(F.col("block").alias(f"{s}block"), F.col("id").alias(s), F.col("lo").alias(f"{s}lo"), F.col("hi").alias(f"{s}hi")), f"{s}block")
    pairs = pairs.filter(_near(g.d, "a", "b") <= g.eps2)
    sure = F.coalesce(_far(g.d, "a", "b") <= g.eps2, F.lit(False))
    apart = kept(pairs.select("a", "b", "ablock", "bblock", "aregion", "bregion", sure.alias("sure"), _middles(g.d, "a", "b").alias("way")), "dbscan-apart")
    most = _NEAREST
    while not apart.isEmpty():
        ranks = [F.row_number().over(Window.partitionBy(s).orderBy("way", t)) for s, t in ("ab", "ba")]
        asked = kept(apart.withColumns({"ra": ranks[0], "rb": ranks[1]}).filter((F.col("ra") <= most) | (F.col("rb") <= most)).drop("ra", "rb"), "dbscan-asked")
        edges = kept(asked.filter("sure").select("a", "b").unionByName(_touching(g, asked.filter("not sure"), cores)), "dbscan-edges")
        la = labels.select(F.col("id").alias("a"), F.col("label").alias("pa"))
        lb = labels.select(F.col("id").alias("b"), F.col("label").alias("pb"))
        joined = edges.join(la, "a").join(lb, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b")).filter("a <> b").distinct()
        higher = components(labels.select(F.col("label").alias("id")).distinct(), joined)
        labels = kept(labels.join(higher.select(F.col("id").alias("label"), F.col("label").alias("to")), "label").select("id", F.col("to").alias("label")), "dbscan-labels")
        la = labels.select(F.col("id").alias("a"), F.col("label").alias("pa"))
        lb = labels.select(F.col("id").alias("b"), F.col("label").alias("pb"))
        left = apart.join(la, "a").join(lb, "b").filter("pa <> pb").drop("pa", "pb").join(asked.select("a", "b"), ["a", "b"], "left_anti")
        apart, most = kept(left, "dbscan-apart"), most * 8
    return labels


def dbscan(df: DataFrame, cols: list[str], eps: float = 0.8, min_pts: int = 5, block: int | None = None, region: int | None = None) -> DataFrame:
    """One row ``(n_rows, noise_points, core_points, clusters)`` for standardised ``cols``, any number of them.

    ``block`` and ``region`` size the pieces of work; they have no influence on the result.
    """
    if not cols:
        raise ValueError("DBSCAN needs a column")
    checkpoint_dir(df.sparkSession)
    df = df.na.drop(subset=cols)
    g = _Blocks(df, cols, eps, min_pts, block, region)
    marked = kept(_with_cores(g), "dbscan-marked")
    cores = kept(g.of_some(marked, "core[i]", "part"), "dbscan-cores")

    alone = kept(g.of_some(marked, "not held[i]", "w"), "dbscan-alone")
    held = _met(g, _facing(g, alone, cores), alone.drop("w"), cores.drop("part"), None)
    weights = alone.select("block", F.explode(F.arrays_zip("at", "w")).alias("p")).select("block", "p.at", "p.w")
    noise = weights.join(held, ["block", "at"], "left_anti")
    final = _clusters(g, cores)

    core_w = F.expr("aggregate(zip_with(w, core, (v, c) -> if(c, v, 0L)), 0L, (t, v) -> t + v)")
    all_w = F.expr("aggregate(w, 0L, (t, v) -> t + v)")
    total = marked.agg(*[F.coalesce(F.sum(w), F.lit(0)).alias(n) for w, n in ((all_w, "n_rows"), (core_w, "core_points"))])
    lost = noise.agg(F.coalesce(F.sum("w"), F.lit(0)).alias("noise_points"))
    groups = final.select("label").distinct().agg(F.count(F.lit(1)).alias("clusters"))
    out = total.crossJoin(F.broadcast(lost)).crossJoin(F.broadcast(groups))
    return out.select("n_rows", "noise_points", "core_points", "clusters")


def dbscan_stage(df: DataFrame, keys: Keys = Keys(), eps: float = 0.8, min_pts: int = 5) -> DataFrame:
    """Quality stage: noise points and clusters over all numeric columns of all complete rows."""
    from .quality import _info, _row, _text

    cols = [c for c in numeric_columns(df) if c != keys.tie]
    if len(cols) < 2 or df.na.drop(subset=cols).limit(20).count() < 20:
        return _info(df, "DBSCAN NOISE", "need more numeric rows")
    noise = F.col("noise_points")
    made = _row(
        "DBSCAN NOISE", F.when(noise > 0, "WARN").otherwise("PASS"), noise,
        F.concat(_text(noise), F.lit(" noise points, "), _text(F.col("clusters")), F.lit(" clusters")),
    )
    return dbscan(df, cols, eps, min_pts).select(made.alias("r")).select("r.*")
