"""Exact distinct counts of all columns of a table; a value is moved only where another part of the table may hold it.

The table is read once in units of some hundred thousand rows.  A unit keeps its own distinct values of each column, with a
64-bit hash of each, in the shared folder.  Of these only 32 bits a value are exchanged, packed by column and by the
hash's leading bits; prints that two units send are set in one bitmap a column.  Values at unset bits live in one unit and
are counted where they are; values at set bits go through an ordinary ``distinct``.  A print shared by chance moves
a value needlessly but never changes a count, so neither the bitmap's size nor the hash has an influence on results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..session import kept

UNIT_ROWS, UNIT_BYTES = 1 << 17, 1 << 25
GROUP_VALUES = 1 << 21  # prints that one group of the exchange is meant to hold
GUARD_BITS = 1 << 26  # bits of all bitmaps together, 8 MB: the size of what is broadcast


def _units(batches: Iterator[pa.RecordBatch], rows: int, size: int) -> Iterator[pa.Table]:
    held, n, weight = [], 0, 0
    for batch in batches:
        held.append(batch)
        n, weight = n + batch.num_rows, weight + batch.nbytes
        if n >= rows or weight >= size:
            yield pa.Table.from_batches(held)
            held, n, weight = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def unit_values(df: DataFrame, unit_rows: int = UNIT_ROWS, unit_bytes: int = UNIT_BYTES) -> DataFrame:
    """position, n, keys, texts: the distinct known values of each column in each unit, by ascending hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in _units(batches, unit_rows, unit_bytes):
            for position, column in enumerate(unit.columns):
                texts = pc.unique(column).drop_null()
                if not len(texts):
                    continue
                keys = pd.util.hash_array(texts.to_numpy(zero_copy_only=False), categorize=False)
                order = np.argsort(keys)
                yield pa.record_batch(
                    [pa.array([position], pa.int32()), pa.array([len(keys)], pa.int64()),
                     pa.array([keys[order].astype("<u8").tobytes()], pa.binary()),
                     pa.array([texts.take(pa.array(order)).to_pylist()], pa.list_(pa.string()))],
                    names=["position", "n", "keys", "texts"],
                )

    cells = df.select(*[F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(df.columns)])
    return cells.mapInArrow(run, "position int, n long, keys binary, texts array<string>")


def _prints(keys: np.ndarray, lead: int) -> np.ndarray:
    """The leading ``lead`` bits of each hash, which choose a group, and the 32 bits behind them."""
    return keys >> np.uint64(32 - lead)


def guard(local: DataFrame, columns: int, guard_bits: int = GUARD_BITS) -> tuple[np.ndarray, int]:
    """Bitmaps (columns x words) in which the prints held by two units or more are set, and the number of leading bits."""
    words = max(1, guard_bits // (64 * max(1, columns)))
    top = local.groupBy("position").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
    lead = min(31, max(0, int(top // GROUP_VALUES).bit_length()))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for position, keys in zip(batch["position"].to_pylist(), batch["keys"].to_pylist()):
                prints = np.unique(_prints(np.frombuffer(keys, "<u8"), lead))
                groups, first = np.unique(prints >> np.uint64(32), return_index=True)
                parts = np.split((prints & np.uint64(0xFFFFFFFF)).astype("<u4"), first[1:])
                yield pa.record_batch(
                    [pa.array([position] * len(groups), pa.int32()), pa.array(groups.astype(np.int64)),
                     pa.array([p.tobytes() for p in parts], pa.binary())],
                    names=["position", "lead", "prints"],
                )

    def shared(key: tuple, table: pa.Table) -> pa.Table:
        prints = np.frombuffer(b"".join(table["prints"].to_pylist()), "<u4")
        prints, units = np.unique(prints, return_counts=True)  # a unit sends a print once
        full = (np.uint64(key[1].as_py()) << np.uint64(32)) | prints[units > 1].astype(np.uint64)
        bits = full % np.uint64(64 * words)
        word, at = np.unique(bits >> np.uint64(6), return_inverse=True)
        value = np.zeros(len(word), np.uint64)
        np.bitwise_or.at(value, at, np.uint64(1) << (bits & np.uint64(63)))
        return pa.table([pa.array(np.full(len(word), key[0].as_py()), pa.int32()), pa.array(word.astype(np.int64)),
                         pa.array(value.view(np.int64))], names=["position", "word", "bits"])

    prints = local.select("position", "keys").mapInArrow(send, "position int, lead long, prints binary")
    found = prints.groupBy("position", "lead").applyInArrow(shared, "position int, word long, bits long")
    found = found.groupBy("position", "word").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most guard_bits / 64 rows
    maps = np.zeros((columns, words), np.uint64)
    maps[found["position"].to_numpy(), found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return maps, lead


def guarded(local: DataFrame, maps: np.ndarray, lead: int) -> DataFrame:
    """position, text, n: values that have to be compared with other units', and counts (text null) of those that haven't."""
    known = local.sparkSession.sparkContext.broadcast(maps)  # GUARD_BITS at most
    total = np.uint64(64 * maps.shape[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for position, keys, texts in zip(batch["position"].to_pylist(), batch["keys"].to_pylist(), batch["texts"]):
                bits = _prints(np.frombuffer(keys, "<u8"), lead) % total
                moves = (known.value[position][bits >> np.uint64(6)] >> (bits & np.uint64(63))) & np.uint64(1) == 1
                text = pa.concat_arrays([texts.values.filter(pa.array(moves)).cast(pa.string()), pa.nulls(1, pa.string())])
                counts = np.zeros(len(text), np.int64)
                counts[-1] = np.count_nonzero(~moves)
                yield pa.record_batch([pa.array(np.full(len(text), position), pa.int32()), text, pa.array(counts)], names=["position", "text", "n"])

    return local.select("position", "keys", "texts").mapInArrow(run, "position int, text string, n long")


def distinct_counts(
    df: DataFrame, unit_rows: int = UNIT_ROWS, unit_bytes: int = UNIT_BYTES, guard_bits: int = GUARD_BITS
) -> DataFrame:
    """One row with ``<column>__distinct`` for each column: how many different known values it has, compared as text.

    Nulls are no value, an empty text is one; an empty table gives zeros.  A column whose values all repeat in other units
    moves them all, like a plain ``distinct`` does after its partial aggregation.
    """
    names = df.columns
    local = kept(unit_values(df, unit_rows, unit_bytes), "distinct")
    maps, lead = guard(local, len(names), guard_bits)
    values = guarded(local, maps, lead).groupBy("position", "text").agg(F.sum("n").alias("n"))
    per = values.groupBy("position").agg(F.sum(F.when(F.col("text").isNull(), F.col("n")).otherwise(1)).alias("n"))
    return per.agg(*[F.coalesce(F.max(F.when(F.col("position") == i, F.col("n"))), F.lit(0)).alias(f"{c}__distinct") for i, c in enumerate(names)])
