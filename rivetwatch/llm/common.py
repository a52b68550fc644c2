"""Helpers shared by the text operators: columns, shared folder, word hashes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

# The white space between words: space, tab, line feed, vertical tab, form feed, carriage return (bytes.split's own).
WORD = r"[^\x20\x09-\x0D]+"
SPACES = b" \t\n\r\x0b\x0c"
_MASK = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, what: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; a scratch one only for a local session without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="rivetwatch-llm-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: lineage ends there and survives lost executors."""
    path = shared_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def doc_text(docs: DataFrame) -> DataFrame:
    """Only ``doc_id`` and ``text`` (null texts as empty), whatever other columns there are."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def fold(doc_id, parts: int):
    """crc32 of the id's decimal text, modulo ``parts``: the folds that learning and testing are split by."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts


def release() -> None:
    """Give memory that a worker no longer uses back to the system; workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def by_bytes(batches, most: int = 1 << 23):
    """Arrow batches cut to some ``most`` bytes each; at least one row."""
    for batch in batches:
        rows = max(1, int(batch.num_rows * most / max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class WordHashes(dict):
    """word (bytes) -> 64-bit hash; forgets all when it has grown to ``most`` words, so memory stays bounded."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_MUL = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the rolling multiplier and of its inverse, modulo 2^64."""
    if len(_POWERS["up"]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        for key, factor in (("up", _MUL), ("down", pow(_MUL, -1, 1 << 64))):
            values = np.full(size, factor, np.uint64)
            values[0] = 1
            _POWERS[key] = np.multiply.accumulate(values)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: spreads the low-quality bits of polynomial hashes."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def rolling(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive entries of ``h`` (empty if there are fewer)."""
    n = len(h)
    if n < width:
        return np.empty(0, np.uint64)
    up, down = powers(n)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(h * up, out=total[1:])
    return mix((total[width:] - total[:-width]) * down[: n - width + 1])
