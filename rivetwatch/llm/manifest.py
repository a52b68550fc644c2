"""Merkle manifest of a dataset with a membership witness for every row, built as a streaming append.

Leaves are put in order by one range exchange and numbered from the counts of its partitions, so no group of rows, and
no language, is ever gathered.  Aligned blocks of 2^12 consecutive leaves are appended to a small frontier of open
subtrees.  A subtree carries the partial witnesses of the leaves below it; when its sibling is complete, each of these is
extended by the sibling's digest and both become one open subtree.  The root of a block is appended in the same way one
level up, in blocks of 2^12 roots, until every group (language) has one root; these are the leaves of the last tree.
Witnesses of the upper levels are attached to roots of blocks, thus 4,096 times fewer rows at each level, and joined down.

A node that is left alone at the end of a level becomes the digest of itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import stored

BITS = 12  # a block holds 2^BITS nodes
TAMPERED = 7  # where this divides the crc32 of the id, the query's check changes the row

LEFT, RIGHT, ALONE = "L", "R", "-"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


class Frontier:
    """Open subtrees of an append, highest first, each with its height, digest and the leaves below it."""

    def __init__(self):
        self.open: list[tuple[int, str, list[int]]] = []
        self.witness: list[list[str]] = []  # per leaf: side and digest of each sibling so far

    def append(self, leaf: str) -> None:
        self.open.append((0, leaf, [len(self.witness)]))
        self.witness.append([])
        while len(self.open) > 1 and self.open[-1][0] == self.open[-2][0]:
            self._join()

    def _join(self) -> None:
        _, right, below_right = self.open.pop()
        height, left, below_left = self.open.pop()
        for i in below_left:
            self.witness[i].append(RIGHT + right)
        for i in below_right:
            self.witness[i].append(LEFT + left)
        self.open.append((height + 1, digest(left, right), below_left + below_right))

    def close(self, height: int | None = None) -> str:
        """Root of all leaves, lifted to ``height``; by default the lowest that holds them all."""
        while len(self.open) > 1 or self.open[0][0] < (height or 0):
            if len(self.open) > 1 and self.open[-1][0] == self.open[-2][0]:
                self._join()
                continue
            h, own, below = self.open.pop()
            for i in below:
                self.witness[i].append(ALONE)
            self.open.append((h + 1, digest(own), below))
        return self.open[0][1]


def siblings(witness: str) -> Iterable[tuple[str, str]]:
    """(side, digest) of a witness, level by level; a level without sibling gives ("-", "")."""
    at = 0
    while at < len(witness):
        side = witness[at]
        at += 1
        yield side, "" if side == ALONE else witness[at : at + 64]
        at += 0 if side == ALONE else 64


def folded(leaf: str, witness: str) -> str:
    """The root that a leaf and its witness lead to."""
    for side, other in siblings(witness):
        leaf = digest(other, leaf) if side == LEFT else digest(leaf, other)
    return leaf


# ---------------------------------------------------------------- order
def numbered(rows: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """``rows`` with ``place`` in their group (from 0, by ``order``) and ``total`` rows of the group; written once.

    Only counts by (partition, group) are gathered, at most as many as partitions and groups together.
    """
    # Rows alike in all of this are spread as well, by a number of their own.
    rows = rows.withColumn("tie", F.monotonically_increasing_id())
    by = [F.col(g).asc_nulls_first() for g in group] + [*order, F.col("tie").asc()]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id())
    laid = stored(laid.withColumn("part", F.shiftright("at", 33)), "manifest-order")
    counts = laid.groupBy(*group, "part").agg(F.count(F.lit(1)).alias("here"), F.min("at").alias("first"))
    w = Window.partitionBy(*[F.col(g) for g in group])
    before = F.coalesce(F.sum("here").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(*[F.col(g).alias(f"o_{g}") for g in group], F.col("part").alias("o_part"), (before - F.col("first")).alias("shift"), F.sum("here").over(w).alias("total"))
    match = F.col("part") == F.col("o_part")
    for g in group:
        match = match & F.col(g).eqNullSafe(F.col(f"o_{g}"))
    return laid.join(offsets, match).select(*rows.columns, (F.col("at") + F.col("shift")).alias("place"), "total").drop("tie")


# ---------------------------------------------------------------- append
def _appended(bits: int, keep: list[str], schema: pa.Schema):
    """One block of one group: every node with its witness up to the block's root, and that root on the first row."""

    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        total, place = table["total"][0].as_py(), table["place"][0].as_py()
        frontier = Frontier()
        for d in table["digest"].to_pylist():
            frontier.append(d)
        # A group of several blocks has them all at one height; a single block stops at its root.
        root = frontier.close(bits if total > 1 << bits else None)
        n = table.num_rows
        columns = {c: table[c] for c in keep} | {
            "block": pa.array([place >> bits] * n, pa.int64()),
            "blocks": pa.array([-(-total >> bits)] * n, pa.int64()),
            "witness": pa.array(["".join(w) for w in frontier.witness], pa.string()),
            "root": pa.array([root] + [None] * (n - 1), pa.string()),
        }
        return pa.table({f.name: columns[f.name] for f in schema}, schema=schema)

    return work


def append_blocks(nodes: DataFrame, group: list[str], keep: list[str], bits: int) -> DataFrame:
    """``keep`` of each node, its block, the number of blocks of its group, its witness in the block, the block's root.

    ``nodes`` have ``group``, ``place``, ``total`` and ``digest``.  A group of aggregation is one block: 2^bits rows.
    """
    kept = [nodes.schema[c] for c in keep]
    out = T.StructType([*kept, T.StructField("block", T.LongType()), T.StructField("blocks", T.LongType()), T.StructField("witness", T.StringType()), T.StructField("root", T.StringType())])
    columns = list(dict.fromkeys([*group, *keep, "place", "total", "digest"]))
    keyed = nodes.select(*columns).groupBy(*[F.col(g) for g in group], F.shiftright("place", bits).alias("own_block"))
    return stored(keyed.applyInArrow(_appended(bits, keep, to_arrow_schema(out)), out), "manifest-blocks")


def trees(nodes: DataFrame, group: list[str], keep: list[str], bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """(``group``, ``keep`` and whole ``witness`` of each node; ``group`` and ``digest`` of each group's root).

    A pass per level of blocks; groups whose root is reached drop out, so a level is 2^bits times smaller than the last.
    """
    levels, tops = [append_blocks(nodes, group, [*group, *keep], bits)], []
    while True:
        # The root stands on a block's first row.
        roots = levels[-1].filter("root is not null").select(*group, F.col("block").alias("place"), F.col("blocks").alias("total"), F.col("root").alias("digest"))
        tops.append(roots.filter("total = 1").select(*group, "digest"))
        if roots.filter("total > 1").isEmpty():
            break
        levels.append(append_blocks(roots.filter("total > 1"), group, [*group, "place"], bits))
    # From the top down every block's root gets the witness of what stands above it.
    whole = levels.pop()
    while levels:
        up = whole.select(*[F.col(g).alias(f"u_{g}") for g in group], F.col("place").alias("u_place"), F.col("witness").alias("u_witness"))
        match = F.col("block") == F.col("u_place")
        for g in group:
            match = match & F.col(g).eqNullSafe(F.col(f"u_{g}"))
        below = levels.pop()
        whole = below.join(up, match, "left").select(*below.columns[:-2], F.concat("witness", F.coalesce("u_witness", F.lit(""))).alias("witness"))
    return whole.select(*group, *keep, "witness"), reduce(DataFrame.unionByName, tops)


# ---------------------------------------------------------------- the manifest of documents
def field(c: Column) -> Column:
    """Expression: a value as UTF-8 byte count, ``:`` and text; ``-`` if null."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.sha2(F.concat(*map(field, (doc_id, source, lang, n_chars, text))), 256)


def manifest(docs: DataFrame, bits: int = BITS, tampered: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(a row per document: doc_id, lang, leaf, changed_leaf, witness up to its subroot; a row per lang: subroot, witness up to the root).

    ``changed_leaf`` is the leaf with one more in ``n_chars`` where ``tampered`` holds (for checks), null elsewhere.
    """
    ids = [F.col(c).cast("long").alias(c) if c in ("doc_id", "n_chars") else F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    own = docs.select(*ids)
    parts = [F.col(c) for c in own.columns]
    one_more = leaf_of(*parts[:3], F.col("n_chars") + 1, parts[4])
    changed = F.when(tampered, one_more) if tampered is not None else F.lit(None).cast("string")
    leaves = own.select("doc_id", "lang", leaf_of(*parts).alias("digest"), changed.alias("changed_leaf"))
    nodes = numbered(leaves, ["lang"], [F.col("doc_id").asc_nulls_first(), F.col("digest").asc()])
    rows, subroots = trees(nodes, ["lang"], ["doc_id", "digest", "changed_leaf"], bits)
    # Languages are the leaves of the last tree, in one group.
    tops = numbered(subroots.select(F.lit(0).alias("all"), F.col("lang").alias("name"), "digest"), ["all"], [F.col("name").asc_nulls_first()])
    langs, root = trees(tops, ["all"], ["name", "digest"], bits)
    rows = rows.withColumnRenamed("digest", "leaf")
    return rows, langs.select(F.col("name").alias("lang"), F.col("digest").alias("subroot"), "witness").join(root.select(F.col("digest").alias("root")), F.lit(True), "left")


def verified(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """Per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Leaves hash doc_id, source, lang, n_chars and text; per lang they stand by doc_id (nulls first, then equal ids by
    leaf); subroots stand by lang (null first) under the root.  The check folds each row's witness over its leaf, changed
    by one in ``n_chars`` where ``TAMPERED`` divides the crc32 of its doc_id (rows without doc_id and null ``n_chars``
    stay), and compares with the root.  Rows alike in all columns have leaves of their own.  Empty texts are hashed as
    such, other columns are ignored, no rows give no rows.
    """
    bad = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0
    rows, langs = manifest(docs, bits, F.coalesce(bad, F.lit(False)))
    upper = langs.select(F.col("lang").alias("u_lang"), "subroot", "root", F.col("witness").alias("upper"))
    joined = rows.join(upper, F.col("lang").eqNullSafe(F.col("u_lang"))).select("doc_id", "leaf", "changed_leaf", "subroot", "root", "witness", "upper")

    def check(batches):
        for batch in batches:
            proofs, roots, good = [], [], []
            for leaf, changed, root, witness, upper_ in zip(*(batch.column(i).to_pylist() for i in (1, 2, 4, 5, 6))):
                path = witness + upper_
                proofs.append(digest(*(d for _, d in siblings(path))))
                roots.append(folded(changed or leaf, path))
                good.append(roots[-1] == root)
            text = pa.string()
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in (0, 1, 3, 4)), pa.array(proofs, text), pa.array(roots, text), pa.array(good, pa.bool_())],
                ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
            )

    return joined.mapInArrow(check, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def _tree_sql(name: str, source: str, group: str, levels: int) -> str:
    """CTEs ``{name}_0`` .. ``{name}_{levels}``: nodes (group, i, h, n) level by level; a single node stays as it is."""
    out = [f"{name}_0 AS MATERIALIZED ({source})"]
    for k in range(levels):
        below = f"{name}_{k}"
        out.append(
            f"{name}_{k + 1} AS MATERIALIZED (SELECT {group}, i // 2 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h, (n + 1) // 2 AS n FROM {below} WHERE n > 1 GROUP BY {group}, i // 2, n "
            f"UNION ALL SELECT {group}, i, h, n FROM {below} WHERE n = 1)"
        )
    return ", ".join(out)


def _fold_sql(name: str, source: str, group: str, levels: int) -> str:
    """CTEs ``{name}_f0`` .. : per row of ``source`` (r, group, i, n, f, p) the folded digest ``f`` and the siblings ``p`` so far."""
    out = [f"{name}_f0 AS ({source})"]
    for k in range(levels):
        out.append(
            f"{name}_f{k + 1} AS MATERIALIZED (SELECT a.* REPLACE (a.i // 2 AS i, CASE WHEN a.n > 1 THEN (a.n + 1) // 2 ELSE 1 END AS n, a.p || coalesce(s.h, '') AS p, "
            f"CASE WHEN a.n = 1 THEN a.f WHEN s.h IS NULL THEN sha256(a.f) WHEN a.i % 2 = 0 THEN sha256(a.f || s.h) ELSE sha256(s.h || a.f) END AS f) "
            f"FROM {name}_f{k} a LEFT JOIN {name}_{k} s ON s.{group} IS NOT DISTINCT FROM a.{group} AND a.n > 1 AND s.i = xor(a.i, 1))"
        )
    return ", ".join(out)


def _sql(levels: int = 17, upper: int = 8) -> str:
    """Up to 2^levels documents in a language and 2^upper languages."""

    def parts(n_chars: str) -> str:
        text = [f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", n_chars, "text")]
        return f"sha256({' || '.join(text)})"

    # The crc32 by its definition, bit by bit over the decimal digits.
    crc = (
        "xor(list_reduce([4294967295] || flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: list_transform(range(8), lambda j: CAST((ascii(c) >> j) & 1 AS BIGINT)))), "
        "lambda a, b: xor(a >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295)"
    )
    d = f"d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, lang, {parts('n_chars')} AS h, CASE WHEN doc_id IS NOT NULL AND {crc} % {TAMPERED} = 0 THEN {parts('n_chars + 1')} ELSE {parts('n_chars')} END AS c FROM documents)"
    o = "o AS MATERIALIZED (SELECT r, doc_id, lang, h, c, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM d)"
    t = _tree_sql("t", "SELECT lang, i, h, n FROM o", "lang", levels)
    u = _tree_sql("u", f"SELECT 1 AS one, lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM t_{levels}", "one", upper)
    a = _fold_sql("t", "SELECT r, doc_id, lang, h AS leaf, i, n, c AS f, '' AS p FROM o", "lang", levels)
    b = _fold_sql("u", f"SELECT a.r, a.doc_id, a.leaf, s.h AS subroot, 1 AS one, s.i, s.n, a.f, a.p FROM t_f{levels} a JOIN u_0 s ON s.lang IS NOT DISTINCT FROM a.lang", "one", upper)
    return (
        f"WITH {d}, {o}, {t}, {u}, {a}, {b} SELECT doc_id, leaf, subroot, u_{upper}.h AS root, sha256(p) AS proof_sha256, f AS folded_root, f = u_{upper}.h AS verified FROM u_f{upper}, u_{upper}"
    )


SQL = _sql()
