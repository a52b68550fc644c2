"""Substring dedup by fixed-block anchors: words inside a window of 50 that starts in an earlier document go.

Every document's text is cut into non-overlapping blocks of 25 words, the *reference blocks*; a run of 50 equal words
holds at least one whole block of either document.  Every document's rolling windows of 25 words are probed against the
blocks of all documents.  Where a probe meets a block of another document there is an anchor, and the repeat around it
is extended word by word: every window of 50 words that covers the anchor is looked up among those that other documents
have around theirs, and neighbouring windows found join into the maximal repeat.

Documents are dealt into batches by a hash of doc_id.  A batch sends packed hashes, each once, to hash buckets of
bounded size, and the buckets answer with what matters to the batch.  So a passage that a third of all documents share
costs one entry per batch, never a pair of documents, and the texts are shuffled once.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import WordHashes, release, rolling

WINDOW = 50
BATCH_DOCS = 1024
BUCKET_WINDOWS = 1 << 20
_REST = 38  # bits of an anchor's hash below its bucket's; with two flags they make five bytes

_WORDS = re.compile(rb"[^ \t\n\r\x0b\x0c]+")


def _five(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _from_five(data: bytes) -> np.ndarray:
    raw = np.zeros((len(data) // 5, 8), np.uint8)
    raw[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return raw.view("<u8").ravel()


# One per worker process: the same words come again in every batch.
_HASHES = WordHashes()


def _documents(table: pa.Table) -> list[tuple[int, np.ndarray]]:
    """(doc_id, word hashes) in ascending order of doc_id; rows without doc_id take no part."""
    ids, texts = table["doc_id"].to_pylist(), table["text"]
    order = sorted((d, i) for i, d in enumerate(ids) if d is not None)
    return [(d, _HASHES.of(texts[i].as_py().split())) for d, i in order]


def _runs(sorted_values: np.ndarray) -> np.ndarray:
    """Starts of runs of equal values."""
    new = np.ones(len(sorted_values), bool)
    new[1:] = sorted_values[1:] != sorted_values[:-1]
    return np.flatnonzero(new)


def _by_bucket(buckets: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of sorted bucket numbers."""
    starts = _runs(buckets)
    return list(zip(buckets[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(buckets)]))


def _anchors_of(bits: int, block: int):
    """A batch's distinct probes, packed by bucket: hash, whether it is a reference block, whether two documents have it."""

    def work(key, table):
        probes, owner, aligned = [], [], []
        for d, h in _documents(table):
            p = rolling(h, block)
            probes.append(p >> np.uint64(64 - bits - _REST))
            owner.append(np.full(len(p), d, np.int64))
            aligned.append(np.arange(len(p)) % block == 0)
        out: dict[str, list] = {"bucket": [], "batch": [], "data": []}
        if probes and sum(map(len, probes)):
            all_ = np.concatenate(probes)
            order = np.argsort(all_, kind="stable")
            all_, own = all_[order], np.concatenate(owner)[order]
            starts = _runs(all_)
            ends = np.append(starts[1:], len(all_)) - 1
            block_here = np.logical_or.reduceat(np.concatenate(aligned)[order], starts)
            several = own[starts] != own[ends]
            keys = all_[starts]
            values = (keys & np.uint64((1 << _REST) - 1)) << np.uint64(2) | block_here.astype(np.uint64) << np.uint64(1) | several.astype(np.uint64)
            for b, i, j in _by_bucket((keys >> np.uint64(_REST)).astype(np.int64)):
                out["bucket"].append(b)
                out["batch"].append(key[0].as_py())
                out["data"].append(_five(values[i:j]))
        return pa.table(out, schema=_PACKED)

    return work


_PACKED = pa.schema([("bucket", pa.int64()), ("batch", pa.int64()), ("data", pa.binary())])
_PACKED_DDL = "bucket long, batch long, data binary"


def _shared_anchors(key, table):
    """Of one bucket: for each batch, the hashes it has that are a reference block somewhere and in several documents."""
    parts = [_from_five(x) for x in table["data"].to_pylist()]
    values = np.concatenate(parts)
    row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    order = np.argsort(values >> np.uint64(2), kind="stable")
    values, row = values[order], row[order]
    rest = values >> np.uint64(2)
    starts = _runs(rest)
    count = np.diff(np.append(starts, len(rest)))
    flags = np.bitwise_or.reduceat(values & np.uint64(3), starts)
    good = np.repeat((flags >= 2) & ((count > 1) | (flags & np.uint64(1) > 0)), count)
    release()
    return _answers(key, table, rest[good], row[good], _five)


def _answers(key, table: pa.Table, values: np.ndarray, row: np.ndarray, pack) -> pa.Table:
    order = np.argsort(row, kind="stable")
    batches = table["batch"].to_pylist()
    out: dict[str, list] = {"bucket": [], "batch": [], "data": []}
    for r, i, j in _by_bucket(row[order]):
        out["bucket"].append(key[0].as_py())
        out["batch"].append(batches[r])
        out["data"].append(pack(values[order[i:j]]))
    return pa.table(out, schema=_PACKED)


def _windows_of(bits: int, window: int, block: int):
    """A batch's distinct windows around its anchors, packed by bucket: hash and smallest doc_id here that has it."""

    def work(key, table, found):
        out: dict[str, list] = {"bucket": [], "batch": [], "data": []}
        anchors = [_from_five(d) | np.uint64(b << _REST) for b, d in zip(found["bucket"].to_pylist(), found["data"].to_pylist())]
        if anchors and table.num_rows:
            known = np.sort(np.concatenate(anchors))
            windows, owner = [], []
            for d, h in _documents(table):
                if len(h) < window:
                    continue
                p = rolling(h, block) >> np.uint64(64 - bits - _REST)
                at = np.minimum(np.searchsorted(known, p), len(known) - 1)
                hits = np.flatnonzero(known[at] == p)
                if not len(hits):
                    continue
                last = len(h) - window
                around = np.zeros(last + 2, np.int64)
                np.add.at(around, np.minimum(np.maximum(hits - (window - block), 0), last + 1), 1)
                np.add.at(around, np.minimum(hits, last) + 1, -1)
                w = rolling(h, window)[np.cumsum(around)[: last + 1] > 0]
                windows.append(w)
                owner.append(np.full(len(w), d, np.int64))
            if windows:
                all_ = np.concatenate(windows)
                order = np.argsort(all_, kind="stable")
                starts = _runs(all_[order])
                w, own = all_[order][starts], np.concatenate(owner)[order][starts]
                for b, i, j in _by_bucket((w >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(w), np.int64)):
                    out["bucket"].append(b)
                    out["batch"].append(key[0].as_py())
                    out["data"].append(_with_owner(w[i:j], own[i:j]))
        return pa.table(out, schema=_PACKED)

    return work


def _with_owner(w: np.ndarray, own: np.ndarray) -> bytes:
    """Hashes, then owners as differences to the smallest in as few bytes as do."""
    base = int(own.min())
    shifted = (own - base).astype(np.uint64)
    width = 4 if int(shifted.max()) < 1 << 32 else 8
    return np.array([len(w), width], "<u4").tobytes() + np.array([base], "<i8").tobytes() + w.astype("<u8").tobytes() + shifted.astype(f"<u{width}").tobytes()


def _split_owner(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, width = np.frombuffer(data, "<u4", 2).tolist()
    base = int(np.frombuffer(data, "<i8", 1, 8)[0])
    return np.frombuffer(data, "<u8", n, 16), base + np.frombuffer(data, f"<u{width}", n, 16 + 8 * n).astype(np.int64)


def _earlier_windows(key, table):
    """Of one bucket: for each batch, the windows that start in a document of another batch before all it has there."""
    parts = [_split_owner(x) for x in table["data"].to_pylist()]
    w, own = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    row = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    order = np.argsort(w, kind="stable")
    w, own, row = w[order], own[order], row[order]
    starts = _runs(w)
    count = np.diff(np.append(starts, len(w)))
    late = np.repeat(np.minimum.reduceat(own, starts), count) < own
    return _answers(key, table, w[late], row[late], lambda v: v.astype("<u8").tobytes())


def _cut(window: int, keep: list[str], schema: pa.Schema):
    """Documents of a batch without the words that repeat earlier ones; whole texts that lose nothing stay as they are."""

    def work(_key, table, found):
        n, ids, texts = table.num_rows, table["doc_id"].to_pylist(), table["text"]
        words = np.zeros(n, np.int64)
        removed, kept = np.zeros(n, np.int64), [b""] * n
        outside = np.sort(np.concatenate([np.frombuffer(x, "<u8") for x in found["data"].to_pylist()])) if found.num_rows else np.empty(0, np.uint64)
        own, first, places = [], [], []
        order = sorted(range(n), key=lambda i: (ids[i] is None, ids[i] or 0, i))
        for i in order:
            kept[i] = texts[i].as_py()
            parts = kept[i].split()
            words[i] = len(parts)
            if ids[i] is not None and len(parts) >= window:
                w = rolling(_HASHES.of(parts), window)
                own.append(w)
                first.append(np.full(len(w), ids[i], np.int64))
                places.append((i, len(w)))
        if own:
            all_, d = np.concatenate(own), np.concatenate(first)
            by = np.argsort(all_, kind="stable")  # equal windows stay in order of doc_id
            starts = _runs(all_[by])
            count = np.diff(np.append(starts, len(by)))
            late = np.zeros(len(all_), bool)
            late[by] = np.repeat(d[by][starts], count) < d[by]
            if len(outside):
                late |= outside[np.minimum(np.searchsorted(outside, all_), len(outside) - 1)] == all_
            at = 0
            for i, m in places:
                hit = np.flatnonzero(late[at : at + m])
                at += m
                if len(hit):
                    cover = np.zeros(words[i] + 1, np.int64)
                    np.add.at(cover, hit, 1)
                    np.add.at(cover, hit + window, -1)
                    gone = np.cumsum(cover)[:-1] > 0
                    removed[i] = int(gone.sum())
                    kept[i] = _without(kept[i], gone)
        columns = {k: table[k] for k in keep} | {"n_words": words, "n_removed": removed, "kept": pa.array(kept, pa.binary())}
        return pa.table({f.name: columns[f.name] for f in schema}).cast(schema)

    return work


def _without(text: bytes, gone: np.ndarray) -> bytes:
    """``text`` without the words marked; each takes the white space behind it along."""
    spans = [m.start() for m in _WORDS.finditer(text)]
    starts = np.array([*spans, len(text)])
    edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
    out, at = [], 0
    for a, b in zip(edge[::2], edge[1::2]):
        out.append(text[at : starts[a]])
        at = int(starts[b])
    return b"".join([*out, text[at:]])


def without_repeats(docs: DataFrame, window: int = WINDOW, keep: list[str] | None = None) -> DataFrame:
    """``docs``' columns ``keep`` (doc_id alone by default), n_words, n_removed and ``kept`` (what is left, bytes).

    A word goes if a window of ``window`` words that covers it also starts in a document with a smaller doc_id; windows
    are those of the input.  Null texts have no words.  Rows without doc_id stay whole and remove nothing; rows that
    repeat a doc_id don't remove each other's words.  An empty table gives no rows.
    """
    keep = keep or ["doc_id"]
    block = window // 2
    own = docs.withColumn("text", F.coalesce(F.col("text"), F.lit("")).cast("binary")).withColumn("doc_id", F.col("doc_id").cast("long"))
    n, size = own.agg(F.count(F.lit(1)), F.sum(F.length("text"))).first()
    batches = max(1, -(-n // BATCH_DOCS))
    bits = max(1, int(np.ceil(np.log2(max(1, (size or 0) / 6 / BUCKET_WINDOWS)))))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = list(dict.fromkeys([*keep, "doc_id", "text"]))
    # One exchange of the texts serves all three uses below.
    base = own.select(*columns, F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("long").alias("batch")).repartition(parts, "batch")
    anchors = base.groupBy("batch").applyInArrow(_anchors_of(bits, block), _PACKED_DDL)
    shared = anchors.groupBy("bucket").applyInArrow(_shared_anchors, _PACKED_DDL)
    windows = base.groupBy("batch").cogroup(shared.groupBy("batch")).applyInArrow(_windows_of(bits, window, block), _PACKED_DDL)
    earlier = windows.groupBy("bucket").applyInArrow(_earlier_windows, _PACKED_DDL)
    out = T.StructType([*[own.schema[k] for k in keep], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.BinaryType())])
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in out])
    return base.groupBy("batch").cogroup(earlier.groupBy("batch")).applyInArrow(_cut(window, keep, arrow), out)


def trimmed(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs``, all columns, with repeated passages cut out of ``text`` (and ``n_chars``, if there, counted anew).

    Documents of which nothing is left go; texts that lose nothing stay as they are.
    """
    keep = [c for c in docs.columns if c != "text"]
    named = docs.select(F.struct(*keep).alias("row"), "doc_id", "text")
    left = without_repeats(named, window, ["row"]).filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    out = left.select("row.*", F.col("kept").cast("string").alias("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 (kept words joined by one space)."""

    def run(batches):
        for batch in batches:
            shas = [hashlib.sha256(b" ".join(x.split())).hexdigest() for x in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(shas, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return without_repeats(docs, window).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w)
), hits AS (
  SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY g) AS m FROM windows) WHERE m < doc_id
), gone AS (
  SELECT doc_id, list(DISTINCT p) AS p FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM hits) GROUP BY 1
)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(p), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN p IS NULL THEN w ELSE list_filter(w, lambda x, k: NOT list_contains(p, k)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN gone ON gone.doc_id = w.doc_id
"""
