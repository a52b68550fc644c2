"""Token ids in wavelet-matrix shards: one compressed blob per shard with access, rank and select.

A wavelet matrix keeps a sequence of ids as bit planes, highest bit first; below each plane the ids are stably sorted by
that bit.  With counts of set bits at regular places, the id at a place, the count of an id before a place and the
place of its k-th occurrence each take one step per plane.  A shard holds ids of consecutive documents, in
segments of whole documents of at most ``SEGMENT`` ids (or one longer document), so memory doesn't grow with a shard.

File format of a segment (little-endian): magic ``WMX1``, uint32 number of ids, uint8 planes, uint32 documents,
uint32 size of each compressed part, then the parts, zstd-compressed one by one so that a reader opens only what it
needs: document ids (int64 deltas), ids per document (uint32; a document that goes on in the next segment counts in
both, with a flag per document), the numbers of zeros per plane (uint32), then one part of packed bits per plane.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from .bytebpe import PieceCache, Vocabulary, encode_texts
from .common import by_bytes, doc_text, release, shared_path

SEGMENT = 1 << 20
_MAGIC, _HEAD = b"WMX1", struct.Struct("<4sIBI")
_SAMPLE = 512  # bits between two counts of set bits


def _pack(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def build(ids: np.ndarray, doc_ids: np.ndarray, counts: np.ndarray) -> bytes:
    """The blob of one segment: ``ids`` of documents ``doc_ids``, ``counts`` each."""
    planes = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    zeros, bits = np.empty(planes, "<u4"), []
    current = ids.astype(np.uint16 if planes <= 16 else np.uint32)
    for p in range(planes - 1, -1, -1):
        bit = (current >> p & 1).astype(bool)
        bits.append(_pack(np.packbits(bit, bitorder="little").tobytes()))
        current = np.concatenate([low := current[~bit], current[bit]])
        zeros[planes - 1 - p] = len(low)
    parts = [_pack(np.diff(doc_ids, prepend=0).astype("<i8").tobytes()), _pack(counts.astype("<u4").tobytes()), _pack(zeros.tobytes()), *bits]
    return _HEAD.pack(_MAGIC, len(ids), planes, len(doc_ids)) + struct.pack(f"<{len(parts)}I", *map(len, parts)) + b"".join(parts)


class WaveletMatrix:
    """Reader of a blob; parts are decompressed when first used."""

    def __init__(self, blob: bytes):
        magic, self.n, self.planes, self.docs = _HEAD.unpack_from(blob)
        if magic != _MAGIC:
            raise ValueError("not a wavelet-matrix segment")
        sizes = struct.unpack_from(f"<{self.planes + 3}I", blob, _HEAD.size)
        at = _HEAD.size + 4 * len(sizes) + np.cumsum([0, *sizes])
        self._parts = [blob[a:b] for a, b in zip(at, at[1:])]
        self._planes: list[tuple[np.ndarray, np.ndarray] | None] = [None] * self.planes
        self.zeros = np.frombuffer(self._open(2), "<u4").astype(np.int64)

    def _open(self, part: int) -> bytes:
        return zstandard.ZstdDecompressor().decompress(self._parts[part])

    def documents(self) -> tuple[np.ndarray, np.ndarray]:
        """(ids of documents, number of token ids of each)."""
        return np.cumsum(np.frombuffer(self._open(0), "<i8")), np.frombuffer(self._open(1), "<u4").astype(np.int64)

    def _bits(self, p: int) -> np.ndarray:
        return np.unpackbits(np.frombuffer(self._open(3 + p), np.uint8), count=self.n, bitorder="little")

    def _plane(self, p: int) -> tuple[np.ndarray, np.ndarray]:
        if self._planes[p] is None:
            bits = self._bits(p)
            blocks = np.add.reduceat(bits, np.arange(0, self.n, _SAMPLE), dtype=np.int64) if self.n else np.empty(0, np.int64)
            self._planes[p] = bits, np.append(0, np.cumsum(blocks))
        return self._planes[p]

    def _ones(self, p: int, i: int) -> int:
        bits, sums = self._plane(p)
        block = i // _SAMPLE
        return int(sums[block]) + int(bits[block * _SAMPLE : i].sum())

    def _select(self, p: int, k: int, bit: int) -> int:
        """Place of the k-th (from 0) ``bit`` in plane ``p``."""
        bits, sums = self._plane(p)
        counts = sums if bit else np.minimum(np.arange(len(sums)) * _SAMPLE, self.n) - sums
        block = int(np.searchsorted(counts, k, "right")) - 1
        inside = np.flatnonzero(bits[block * _SAMPLE : (block + 1) * _SAMPLE] == bit)
        return block * _SAMPLE + int(inside[k - int(counts[block])])

    def access(self, i: int) -> int:
        """The id at place ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for p in range(self.planes):
            bit = int(self._plane(p)[0][i])
            ones = self._ones(p, i)
            i = int(self.zeros[p]) + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def rank(self, token: int, i: int) -> int:
        """How often ``token`` stands before place ``i``."""
        if token >> self.planes or token < 0:
            return 0
        low, high = 0, min(i, self.n)
        for p in range(self.planes):
            a, b = self._ones(p, low), self._ones(p, high)
            if token >> (self.planes - 1 - p) & 1:
                low, high = int(self.zeros[p]) + a, int(self.zeros[p]) + b
            else:
                low, high = low - a, high - b
        return high - low

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of ``token``."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        low = 0
        for p in range(self.planes):
            ones = self._ones(p, low)
            low = int(self.zeros[p]) + ones if token >> (self.planes - 1 - p) & 1 else low - ones
        i = low + k
        for p in range(self.planes - 1, -1, -1):
            bit = token >> (self.planes - 1 - p) & 1
            i = self._select(p, i - int(self.zeros[p]), 1) if bit else self._select(p, i, 0)
        return i

    def all_ids(self) -> np.ndarray:
        """The whole sequence: the planes undone from the lowest up, one at a time."""
        values = np.zeros(self.n, np.uint16 if self.planes <= 16 else np.uint32)
        for p in range(self.planes - 1, -1, -1):
            bit = self._bits(p).astype(bool)
            back = np.empty_like(values)
            zeros = int(self.zeros[p])
            back[~bit] = values[:zeros]
            back[bit] = values[zeros:] | values.dtype.type(1 << (self.planes - 1 - p))
            values = back
        return values


def library_pieces(source: str, vocab: Vocabulary):
    """Encoder of pretokens by the tokenizers library; words behind a space go in together, each opening anew."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_str(source)
    library.no_truncation()
    library.no_padding()

    def encode(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not pieces:
            return np.empty(0, np.uint32), np.zeros(0, np.int64)
        words = [i for i, p in enumerate(pieces) if p[0] == " " and p[1:].isalpha()]
        alone = sorted({*range(len(pieces))} - {*words})
        order, parts, sizes = [], [], []
        groups = [words[i : i + 512] for i in range(0, len(words), 512)]
        for group, e in zip(groups, library.encode_batch_fast(["".join([pieces[i] for i in g]) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            marks = np.flatnonzero(vocab.opens[ids])
            if len(marks) != len(group):  # a letter that the library takes for none
                alone += group
                continue
            order += group
            parts.append(ids)
            sizes.append(np.diff(np.append(marks, len(ids))))
        each = [e.ids for e in library.encode_batch_fast([pieces[i] for i in alone], add_special_tokens=False)]
        order += alone
        parts += [np.array(ids, np.uint32) for ids in each]
        sizes.append(np.fromiter(map(len, each), np.int64, len(each)))
        # From the order they were encoded in to the order of the pieces.
        flat, size = np.concatenate(parts), np.concatenate(sizes)
        lengths, start = np.empty(len(pieces), np.int64), np.empty(len(pieces), np.int64)
        lengths[order], start[order] = size, np.cumsum(size) - size
        ends = np.cumsum(lengths)
        return flat[np.repeat(start - (ends - lengths), lengths) + np.arange(ends[-1])], lengths

    return encode


_CACHE: dict[str, tuple[Vocabulary, PieceCache]] = {}


def _encoder(source: str) -> tuple[Vocabulary, PieceCache]:
    if source not in _CACHE:
        _CACHE.clear()
        vocab = Vocabulary(source)
        _CACHE[source] = vocab, PieceCache(library_pieces(source, vocab), most=1 << 19)  # some 80 MB at most
    return _CACHE[source]


def token_runs(docs: DataFrame, tokenizer_path: str, end_id: int, cuts: np.ndarray) -> DataFrame:
    """(doc_id, shard, ids): each document's packed ids with ``end_id`` last, and the number of ``cuts`` up to its id."""
    with open(tokenizer_path, encoding="utf-8") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())  # one tokenizer file: a few MB whatever the data

    def run(batches):
        vocab, cache = _encoder(source.value)
        for batch in by_bytes(batches):
            keys, packed, parts = batch.column(0), [], []
            for _, ids, last in encode_texts(batch.column(1).to_pylist(), cache, vocab):
                parts.append(ids)
                if last:
                    packed.append(np.append(np.concatenate(parts), np.uint32(end_id)).astype("<u4").tobytes())
                    parts = []
            shard = np.searchsorted(cuts, keys.fill_null(_NO_ID).to_numpy(zero_copy_only=False), "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([keys, pa.array(shard), pa.array(packed, pa.binary())], ["doc_id", "shard", "ids"])
        release()

    return doc_text(docs).mapInArrow(run, "doc_id long, shard int, ids binary")


def write_shards(docs: DataFrame, tokenizer_path: str, path: str, shards: int | None = None, end_id: int = 0) -> None:
    """Encode ``docs`` and write them to ``path`` as wavelet shards in ascending document order.

    A shard is a range of doc_id; there are four for each shuffle partition unless ``shards`` says otherwise.  The
    bounds come from a scan of the doc_id column alone, so texts are encoded once, where they are read, and only
    packed ids are shuffled.  One row per segment: shard, before (ids of the shard's earlier segments), n_ids, blob.
    Rows without doc_id come first; repeated rows stay repeated; an empty table gives an empty folder.
    """
    spark = docs.sparkSession
    shards = shards or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("k"))
    cuts = keys.agg(F.percentile_approx("k", [i / shards for i in range(1, shards)], 20 * shards)).first()[0] if shards > 1 else None
    cuts = np.unique(np.array(cuts or [], np.int64))  # one number per shard
    runs = token_runs(docs, tokenizer_path, end_id, cuts)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, before, size = None, 0, 0
        keys: list[int] = []
        runs: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal before, size
            blob = build(np.concatenate(runs), np.array(keys, np.int64), np.array([len(r) for r in runs]))
            values = ((shard, pa.int32()), (before, pa.int64()), (size, pa.int64()), (blob, pa.binary()))
            before, size = before + size, 0
            keys.clear()
            runs.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in values], ["shard", "before", "n_ids", "blob"])

        for batch in batches:
            for s, d, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                ids = np.frombuffer(packed.as_buffer(), "<u4")
                if runs and (s != shard or size + len(ids) > SEGMENT):
                    yield flush()
                if s != shard:
                    shard, before = s, 0
                keys.append(_NO_ID if d is None else d)
                runs.append(ids)
                size += len(ids)
        if runs:
            yield flush()

    # Rows of one doc_id are put in order by their ids' checksum, so that reruns agree.
    (runs.repartition(max(1, shards // 4), "shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), F.crc32("ids"))
     .select("shard", "doc_id", "ids").mapInArrow(segments, _SEGMENTS).write.parquet(path))


_SEGMENTS = "shard int, before long, n_ids long, blob binary"
_NO_ID = -(1 << 63)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files alone: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    files = spark.read.schema(_SEGMENTS).parquet(path)
    sizes = {r[0]: r[1] for r in files.groupBy("shard").agg(F.sum("n_ids")).collect()}  # one number per shard
    starts, total = {}, 0
    for s in sorted(sizes):
        starts[s] = total
        total += sizes[s]

    def run(batches):
        for batch in batches:
            for s, before, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                shard = WaveletMatrix(blob.as_py())
                keys, counts = shard.documents()
                ids = memoryview(shard.all_ids().astype("<u4")).cast("B")
                ends = np.cumsum(counts)
                crcs = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip((ends - counts).tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, mask=keys == _NO_ID), pa.array(starts[s] + before + ends - counts), pa.array(counts), pa.array(crcs, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("shard", "before", "blob").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_shards(docs: DataFrame, tokenizer_path: str, path: str | None = None) -> DataFrame:
    """Write ``docs`` as wavelet shards (to the shared folder unless ``path`` is given) and read them back."""
    path = path or shared_path(docs.sparkSession, "wavelet")
    write_shards(docs, tokenizer_path, path)
    return read_shards(docs.sparkSession, path)
