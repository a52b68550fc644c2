"""Connected components of a distributed edge list, and unions inside one task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import stored


def connected(edges: DataFrame) -> DataFrame:
    """(node, component): every node of ``edges`` (long columns a, b) with the smallest node it is joined to.

    The graph is contracted: each node moves to the first of itself and its neighbours, in turn by number (stars whose
    centre has the smallest number are done at once) and by a hash (so that long paths shrink by a share in each
    round).  Rounds are logarithmic; every round is written to the shared folder.
    """
    graph = stored(_simple(edges.select("a", "b")), "edges")
    steps = []
    while not graph.isEmpty():
        turn = len(steps)

        def key(c, turn=turn):
            return F.struct(F.xxhash64(c, F.lit(turn)).alias("k"), c.alias("v")) if turn % 2 else F.struct(c.alias("k"), c.alias("v"))

        both = graph.unionByName(graph.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy("a").agg(F.min(key(F.col("b"))).alias("m"))
        step = stored(step.select(F.col("a").alias("node"), F.least(key(F.col("a")), F.col("m"))["v"].alias("to")), "moves")
        steps.append(step)
        moved = graph.join(step.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a").join(step.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b")
        graph = stored(_simple(moved.select(F.col("ta").alias("a"), F.col("tb").alias("b"))), "edges")
    if not steps:
        return edges.sparkSession.createDataFrame([], "node long, component long")
    out = steps[0]
    for step in steps[1:]:
        later = step.select(F.col("node").alias("to"), F.col("to").alias("next"))
        out = out.join(later, "to", "left").select("node", F.coalesce("next", "to").alias("to"))
    if len(steps) == 1:
        return out.withColumnRenamed("to", "component")
    out = stored(out, "components")
    smallest = out.groupBy("to").agg(F.min("node").alias("component"))
    return out.join(smallest, "to").select("node", "component")


def _simple(edges: DataFrame) -> DataFrame:
    a, b = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    return edges.filter(F.col("a") != F.col("b")).select(a, b).distinct()


class Union:
    """Union-find over 0..n-1; the root of a set is its smallest member."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)

    def roots(self) -> np.ndarray:
        return np.array([self.find(x) for x in range(len(self.up))], np.int64)
