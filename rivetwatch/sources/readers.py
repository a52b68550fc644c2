"""File readers: CSV, TSV, JSON, Parquet and folders of zipped tables."""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# What counts as a table inside an archive, and what is skipped.
TABLE_SUFFIXES = (".csv", ".tsv", ".json")
TEXT_TABLES = (".csv", ".tsv")
JUNK_NAMES = (".ds_store", "thumbs.db")
NO_TABLE = "no CSV/TSV/JSON table in this archive"


def read_csv(spark: SparkSession, path: str, sep: str = ",", infer_time: bool = True) -> DataFrame:
    """Header CSV, every cell text; ``timestamp`` is parsed with bad values as NULL.

    Types are decided later by one aggregate instead of a separate inference scan.
    """
    df = spark.read.option("header", True).option("sep", sep).option("inferSchema", False).csv(path)
    if infer_time and "timestamp" in df.columns:
        df = df.withColumn("timestamp", F.expr("try_cast(`timestamp` AS TIMESTAMP)"))
    return df


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, sep="\t", infer_time=False)


def read_json(spark: SparkSession, path: str, lines: bool = False, schema: T.StructType | None = None) -> DataFrame:
    """Array of records by default; JSON lines split across tasks and suit large data."""
    reader = spark.read.option("multiLine", not lines)
    return (reader.schema(schema) if schema else reader).json(path)


def read_table(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Dispatch on the extension; anything unknown is read as CSV."""
    low = path.lower().split("?")[0].rstrip("/")
    if low.endswith(".parquet"):
        df = spark.read.parquet(path)
    elif low.endswith((".jsonl", ".ndjson")):
        df = read_json(spark, path, lines=True)
    elif low.endswith(".json"):
        df = read_json(spark, path)
    elif low.endswith(".tsv"):
        df = read_tsv(spark, path)
    elif low.endswith(".zip"):
        df = read_zipped(spark, path)
    else:
        df = read_csv(spark, path)
    return df.limit(int(limit)) if limit and limit > 0 else df


def spread_input(df: DataFrame) -> DataFrame:
    """Spread a freshly read table over all cores when its files give fewer splits than there are cores.

    For CPU-heavy work on few or small files.  A table with enough splits is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def load_with_meta(spark: SparkSession, path: str, limit: int | None = None, count: bool = False) -> tuple[DataFrame, dict]:
    """Table plus what is known about the load; rows are counted only on request."""
    df = read_table(spark, path, limit)
    kind = re.sub(r"^.*\.", "", path.lower().split("?")[0].rstrip("/"))
    return df, {"columns": df.columns, "engine": "spark", "kind": kind, "row_limit": limit, "rows": df.count() if count else None}


# ---------------------------------------------------------------- zipped drops
def _inner(name: str) -> str:
    return re.sub(r"^(\./)+", "", name.replace("\\", "/")).lstrip("/")


def is_table_member(name: str) -> bool:
    """Tables only: no directories, resource forks or desktop litter."""
    low = _inner(name).lower()
    base = low.rsplit("/", 1)[-1]
    junk = not base or base.startswith("._") or base in JUNK_NAMES or "__macosx" in low.split("/")
    return not junk and low.endswith(TABLE_SUFFIXES)


def pick_member(members: list[tuple[str, int]]) -> str | None:
    """The only table, else the largest CSV/TSV, else the first table."""
    texts = [m for m in members if _inner(m[0]).lower().endswith(TEXT_TABLES)]
    if len(members) > 1 and texts:
        return max(texts, key=lambda m: m[1])[0]
    return members[0][0] if members else None


def _tables_of(archive: zipfile.ZipFile) -> list[tuple[str, int]]:
    return [(i.filename, i.file_size) for i in archive.infolist() if not i.is_dir() and is_table_member(i.filename)]


def zip_members(spark: SparkSession, path: str) -> DataFrame:
    """Tables found in every archive, with size, position and which one is picked."""

    def listing(batches):
        for batch in batches:
            rows = []
            for name, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    members = _tables_of(z)
                    chosen = pick_member(members)
                rows += [(name, m, size, i, m == chosen) for i, (m, size) in enumerate(members)]
            yield pd.DataFrame(rows, columns=["archive", "member", "bytes", "position", "picked"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(listing, "archive string, member string, bytes long, position int, picked boolean")


def read_zipped(spark: SparkSession, path: str, batch_rows: int = 10_000) -> DataFrame:
    """Rows of the picked table of every archive as ``(archive, member, row, cells)``.

    One task reads one archive and streams its rows in bounded batches; a
    folder of archives spreads over the cluster.  ``cells`` maps header to text,
    because archives need not share a header; see ``spread_cells``.
    """

    def rows_of(z: zipfile.ZipFile, member: str):
        with z.open(member) as raw:
            if member.lower().endswith(".json"):
                for record in json.load(raw):
                    yield {k: None if v is None else str(v) for k, v in record.items()}
            else:
                text = io.TextIOWrapper(raw, encoding="utf-8-sig", newline="")
                for record in csv.DictReader(text, delimiter="\t" if member.lower().endswith(".tsv") else ","):
                    yield {k: v for k, v in record.items() if k is not None and isinstance(v, (str, type(None)))}

    def extract(batches):
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    member = pick_member(_tables_of(z))
                    if member is None:
                        raise ValueError(f"{NO_TABLE}: {name}")
                    held = []
                    for i, cells in enumerate(rows_of(z, member)):
                        held.append((name, member, i, cells))
                        if len(held) >= batch_rows:
                            yield pd.DataFrame(held, columns=["archive", "member", "row", "cells"])
                            held = []
                    yield pd.DataFrame(held, columns=["archive", "member", "row", "cells"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(extract, "archive string, member string, row long, cells map<string,string>")


def spread_cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """Turn the cell map into named text columns."""
    return df.select("archive", "member", "row", *[F.col("cells")[c].alias(c) for c in columns])


# ---------------------------------------------------------------- registry
def register_table(df: DataFrame, name: str) -> str:
    """Register a temp view under a safe name and return that name."""
    safe = re.sub(r"[^A-Za-z0-9_]", "_", name)
    df.createOrReplaceTempView(safe)
    return safe
