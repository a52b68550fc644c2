"""Near-duplicate documents by an LSH forest of MinHash signatures, confirmed on full shingle sets.

Documents with equal sets are one node.  Each tree of the forest orders the nodes by their signature, read from another
place on; nodes next to each other in an order share a long prefix.  A *region* of a tree is what shares its first
``DEPTH`` values.  Nodes of a region whose whole signatures agree in a share of ``HINT`` are candidates; a spanning forest
of them goes on.  Where more than ``REGION`` nodes share a prefix, those that share a longer one meet first; then every
node of the region that this hasn't joined to the region's largest group meets all others, block by block, so no pair
goes uncompared unless its nodes are joined already.  Candidates' components are then compared exactly: the full sets of
a component meet block by block, every pair in it is decided on the sets, and again only a spanning forest of true links
leaves a task.

With 24 trees and depth 4, a pair of similarity 0.8 shares a region with probability 1 - (1 - 0.8^4)^24 > 0.99999, and
the hint (0.65 of 96 values) is four deviations below it; more similar pairs are safer, and a pair also meets in the
exact step if any chain of candidates joins it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import WordHashes, by_bytes, release, rolling, stored
from .components import Union, connected

TREES, DEPTH = 24, 4
VALUES = TREES * DEPTH
HINT = 0.65
REGION = 1024  # nodes compared at once inside a region
BLOCK = 256  # sets of a component that meet another such block in one task
WIDTH, PERCENT = 5, 80

_SEEDS = np.random.default_rng(3).integers(0, 1 << 32, (2, VALUES), dtype=np.uint32)


def shingles(text: bytes, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted hashes of the distinct runs of ``width`` words; of all words if they are fewer; none without words."""
    words = text.lower().split()
    return np.unique(rolling(hashes.of(words), min(width, len(words)))) if words else np.empty(0, np.uint64)


def signature(own: np.ndarray) -> np.ndarray:
    """MinHash values (16 bits each) of a set."""
    low, high = own.astype(np.uint32), (own >> np.uint64(32)).astype(np.uint32)
    best = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(own), 2048):
            values = (low[at : at + 2048, None] ^ _SEEDS[0]) * (_SEEDS[1] | np.uint32(1)) + high[at : at + 2048, None]
            values ^= values >> np.uint32(15)
            values *= np.uint32(0x2C1B3C6D)
            np.minimum(best, values.min(axis=0), out=best)
    best ^= best >> np.uint32(16)
    return best.astype("<u2")


def _sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, k1, k2 (128 bits that name the set), signature (null for the empty set)."""

    def run(batches):
        hashes = WordHashes()
        for batch in by_bytes(batches):
            n, keys, signatures = [], [], []
            for text in batch.column(1):
                own = shingles(text.as_py(), width, hashes)
                n.append(len(own))
                keys.append(xxhash.xxh3_128_digest(own.tobytes()))
                signatures.append(signature(own).tobytes() if len(own) else None)
            names = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(names[:, 0]), pa.array(names[:, 1]), pa.array(signatures, pa.binary())],
                ["doc_id", "n_shingles", "k1", "k2", "signature"])
        release()

    return _binary(docs).mapInArrow(run, "doc_id long, n_shingles long, k1 long, k2 long, signature binary")


def _binary(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))


def _values(tree, step: int):
    """Expression: the ``step``-th four values of a tree's order, as one long."""
    # A tree reads the signature from its own place on and goes on from the start after the end.
    twice = F.concat("signature", "signature")
    return F.conv(F.hex(F.substring(twice, tree * (2 * DEPTH) + 1 + 2 * DEPTH * step, 2 * DEPTH)), 16, -10).cast("long")


def grouped(work: Callable[[tuple, pa.Table], pa.Table | None], keys: list[str], schema: pa.Schema) -> Callable:
    """For mapInArrow over partitions sorted by ``keys``: ``work`` for each run of equal keys, across batch borders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        current: tuple | None = None

        def done():
            out = work(current, pa.concat_tables(held).combine_chunks()) if held else None
            return out.cast(schema).to_batches() if out is not None and out.num_rows else []

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
            change = np.zeros(batch.num_rows, bool)
            for c in columns:
                change[1:] |= c[1:] != c[:-1]
            edges = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                key = tuple(c[a].item() for c in columns)
                if key != current:
                    yield from done()
                    held, current = [], key
                held.append(table.slice(a, b - a))
        yield from done()

    return run


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _alike(sig: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest over rows that agree in at least ``least`` values."""
    n = len(sig)
    if n == 2:
        return [(0, 1)] if int((sig[0] == sig[1]).sum()) >= least else []
    joined = Union(n)
    for i in range(n - 1):
        close = np.flatnonzero((sig[i + 1 :] == sig[i]).sum(axis=1) >= least)
        for j in close.tolist():
            joined.join(i, i + 1 + j)
    roots = joined.roots()
    return [(int(r), i) for i, r in enumerate(roots) if r != i]


def _between(a: np.ndarray, b: np.ndarray, least: int) -> np.ndarray:
    """For the rows of ``a`` and then those of ``b``: the first row that pairs of a row of each, alike in ``least`` values, join it to."""
    agree = np.empty((len(a), len(b)), bool)
    columns = np.ascontiguousarray(b.T)
    for at in range(0, len(a), 64):
        part = a[at : at + 64]
        number = np.zeros((len(part), len(b)), np.uint8)
        for k in range(VALUES):
            number += part[:, k, None] == columns[k]
        agree[at : at + 64] = number >= least
    none = len(a) + len(b)
    left, right = np.arange(len(a)), np.arange(len(a), none)
    while True:
        low = np.minimum(left, np.where(agree, right, none).min(axis=1, initial=none))
        high = np.minimum(right, np.where(agree, low[:, None], none).min(axis=0, initial=none))
        if (low == left).all() and (high == right).all():
            return np.concatenate([low, high])
        left, right = low, high


def candidates(nodes: DataFrame, region: int = REGION, hint: float = HINT) -> DataFrame:
    """Edges (a, b) that join nodes (node, signature) of some region that agree in a share of ``hint``, and no others."""
    trees = F.array(*[F.struct(F.lit(t).alias("tree"), _values(F.lit(t), 0).alias("p")) for t in range(TREES)])
    places = nodes.select("node", F.explode(trees).alias("t")).select("node", "t.tree", "t.p")
    places = stored(places, "forest")
    shared = places.groupBy("tree", "p").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    near = places.join(shared, ["tree", "p"])
    # Fuller regions go deeper first: eight values, then sixteen; what shares even those is dealt by a hash, all parts
    # keeping the smallest node.  ``_across`` compares what this leaves apart.
    rows = near.join(nodes, "node")
    deeper = [_values(F.col("tree"), i) for i in (1, 2, 3)]
    small = rows.filter(F.col("n") <= region).select("tree", "p", F.lit(0).cast("long").alias("q"), F.lit(0).alias("part"), "node", "signature")
    full = rows.filter(F.col("n") > region).withColumn("q8", deeper[0]).withColumn("q16", F.xxhash64(*deeper))
    c8 = full.groupBy("tree", "p", "q8").agg(F.count(F.lit(1)).alias("n8"))
    c16 = full.groupBy("tree", "p", "q16").agg(F.count(F.lit(1)).alias("n16"), F.min("node").alias("first"))
    full = full.join(c8, ["tree", "p", "q8"]).join(c16, ["tree", "p", "q16"])
    q = F.when(F.col("n8") <= region, F.col("q8")).otherwise(F.col("q16"))
    parts = F.when(F.col("n8") <= region, 1).otherwise(F.ceil(F.col("n16") / region)).cast("int")
    own = F.when(F.col("node") == F.col("first"), F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), parts).cast("int")))
    deep = full.select("tree", "p", q.alias("q"), F.explode(own).alias("part"), "node", "signature")
    least = int(np.ceil(hint * VALUES))

    def work(_key, t: pa.Table) -> pa.Table | None:
        if t.num_rows < 2:
            return None
        order = np.argsort(t["node"].to_numpy(), kind="stable")
        ids = t["node"].to_numpy()[order]
        sig = np.frombuffer(b"".join(t["signature"].to_pylist()), "<u2").reshape(-1, VALUES)[order]
        found = _alike(sig, least)
        return pa.table({"a": [int(ids[i]) for i, _ in found], "b": [int(ids[j]) for _, j in found]}, schema=_EDGES) if found else None

    keys = ["tree", "p", "q", "part"]
    # Bounded regions, dealt by their keys: no region is larger than ``region`` nodes or a hashed part of one.
    dealt = small.unionByName(deep).repartition(*keys).sortWithinPartitions(*keys)
    edges = dealt.mapInArrow(grouped(work, keys, _EDGES), "a long, b long").distinct()
    crowded = stored(near.filter(F.col("n") > region).select("tree", "p", "node"), "crowded")
    if crowded.isEmpty():
        return edges
    edges = stored(edges, "close")
    return edges.unionByName(_across(crowded, nodes, stored(connected(edges), "joined"), max(1, region // 2), least))


def _across(crowded: DataFrame, nodes: DataFrame, joined: DataFrame, block: int, least: int) -> DataFrame:
    """Edges that candidates of the full regions (tree, p, node) add to the components (node, component) found so far.

    The nodes of a region's largest component are joined to each other already; every other node of the region meets
    all of its nodes, in pairs of blocks of some ``block`` nodes.
    """
    rows = crowded.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = rows.groupBy("tree", "p", "component").agg(F.count(F.lit(1)).alias("n"))
    largest = F.max(F.struct("n", (-F.col("component")).alias("first")))
    regions = sizes.groupBy("tree", "p").agg(largest.alias("m"), F.sum("n").alias("n")).filter(F.col("n") > F.col("m.n"))
    count = [F.ceil(n / block).cast("int").alias(name) for n, name in ((F.col("n") - F.col("m.n"), "apart"), (F.col("m.n"), "core"))]
    rows = rows.join(regions.select("tree", "p", (-F.col("m.first")).alias("first"), *count), ["tree", "p"])
    # Blocks 0 to apart - 1 hold the nodes that are apart; pairs with one of these are compared.
    inside = F.col("component") == F.col("first")
    rows = rows.withColumn("own", F.when(inside, F.col("apart") + F.pmod(F.xxhash64("node"), F.col("core"))).otherwise(F.pmod(F.xxhash64("node"), F.col("apart"))).cast("int"))
    others = F.sequence(F.lit(0), F.when(inside, F.col("apart")).otherwise(F.col("apart") + F.col("core")) - 1)
    pair = F.explode(F.transform(others, lambda o: F.struct(F.least("own", o).alias("x"), F.greatest("own", o).alias("y"))))
    rows = rows.join(nodes, "node").select("tree", "p", "own", "component", "signature", pair.alias("pair"))
    rows = rows.select("tree", "p", "pair.x", "pair.y", "own", "component", "signature")

    def work(key, t: pa.Table) -> pa.Table | None:
        own, names = t["own"].to_numpy(), t["component"].to_numpy()
        order = np.argsort(own, kind="stable")
        own, names = own[order], names[order]
        sig = np.frombuffer(b"".join(t["signature"].to_pylist()), "<u2").reshape(-1, VALUES)[order]
        x, y = key[2:]
        cut = int(np.searchsorted(own, y)) if x < y else len(own)
        to = _between(sig[:cut], sig[cut:] if x < y else sig, least)
        names = names if x < y else np.concatenate([names, names])
        found = np.unique(np.sort(np.stack([names[to], names], axis=1), axis=1), axis=0)
        found = found[found[:, 0] != found[:, 1]]
        return pa.table({"a": found[:, 0], "b": found[:, 1]}, schema=_EDGES)

    keys = ["tree", "p", "x", "y"]
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(grouped(work, keys, _EDGES), "a long, b long").distinct()


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sorted sets."""
    n = len(sets)
    if n == 2:
        common = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), common], [common, len(sets[1])]])
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, len(flat)))
    column = np.repeat(np.cumsum(count > 1) - 1, count)
    held = np.repeat(count > 1, count)
    row, column = row[held], column[held]
    out = np.zeros((n, n), np.float64)
    edges = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + 4096, 4096))
    for k, (a, b) in enumerate(zip(edges, edges[1:])):
        m = np.zeros((n, 4096), np.float32)
        m[row[a:b], column[a:b] - 4096 * k] = 1
        out += m @ m.T
    out = np.rint(out).astype(np.int64)
    out[np.diag_indices(n)] = [len(s) for s in sets]
    return out


def confirmed(docs: DataFrame, groups: DataFrame, width: int, percent: int, block: int = BLOCK) -> DataFrame:
    """Edges between nodes of each group (node, component) that are true links: a spanning forest for each pair of blocks."""
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    members = groups.join(sizes, "component").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    members = members.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # Always a merge join: whether the members of groups could be broadcast depends on the size of the corpus.
    own = _binary(docs).join(members.withColumnRenamed("node", "doc_id").hint("merge"), "doc_id")

    def sets(batches):
        hashes = WordHashes()
        for batch in by_bytes(batches):
            packed = [shingles(t.as_py(), width, hashes).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary()), *batch.columns[2:]], ["node", "shingles", "component", "blocks", "own"])
        release()

    rows = own.select("doc_id", "text", "component", "blocks", "own").mapInArrow(sets, "node long, shingles binary, component long, blocks int, own int")
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("own", o).alias("x"), F.greatest("own", o).alias("y"))))
    rows = rows.withColumn("pair", pair).select("component", "pair.x", "pair.y", "node", "shingles")

    def work(_key, t: pa.Table) -> pa.Table | None:
        if t.num_rows < 2:
            return None
        ids = t["node"].to_numpy()
        order = np.argsort(ids, kind="stable")
        data = t["shingles"].to_pylist()
        own = [np.frombuffer(data[i], np.uint64) for i in order]
        common = _overlaps(own)
        n = np.diag(common)
        i, j = np.nonzero(np.triu(100 * common >= percent * (n[:, None] + n[None, :] - common), 1))
        joined = Union(len(own))
        for a, b in zip(i.tolist(), j.tolist()):
            joined.join(a, b)
        roots = joined.roots()
        found = np.flatnonzero(roots != np.arange(len(own)))
        ids = ids[order]
        return pa.table({"a": ids[roots[found]], "b": ids[found]}, schema=_EDGES)

    keys = ["component", "x", "y"]
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(grouped(work, keys, _EDGES), "a long, b long")


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id it is joined to by links), kept.

    Links join documents whose sets of ``width``-word shingles have a Jaccard similarity of ``percent`` or more.
    Documents without words have empty sets, link with nothing and are kept.  Rows that repeat a doc_id are one
    document; rows without doc_id link with nothing, have no component and are kept.  No rows give no rows.
    """
    rows = stored(_sketches(docs, width), "sketches")
    full = rows.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    sets = full.groupBy("k1", "k2").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies"), F.any_value("signature").alias("signature"))
    sets = stored(sets, "sets")
    groups = stored(connected(candidates(sets.select("node", "signature").dropDuplicates(["node"]))), "groups")
    links = connected(confirmed(docs, groups, width, percent))
    # Only sets with several documents or links change anything; the others are their own component.
    moved = sets.join(links, "node", "left").filter((F.col("copies") > 1) | F.col("component").isNotNull())
    moved = moved.select("k1", "k2", F.coalesce("component", "node").alias("c"))
    joinable = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.lit(True))
    out = rows.withColumn("j", joinable).join(moved.withColumn("j", F.lit(True)), ["j", "k1", "k2"], "left")
    component = F.coalesce("c", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def without_near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``docs``, all columns, less the documents that ``near_duplicates`` doesn't keep."""
    gone = near_duplicates(docs, width, percent).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM common c JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c.n >= 80 * (x.n + y.n - c.n)
), ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS node, doc_id AS far FROM documents
  UNION
  SELECT r.node, b.b FROM reach r JOIN ways b ON b.a = r.far
), least_ AS (SELECT node, min(far) AS c FROM reach GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, c AS component_id, d.doc_id = c AS kept
FROM documents d JOIN least_ ON node = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""
