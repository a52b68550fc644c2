"""Streaming inputs and the append-only log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def csv_stream(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int = 1) -> DataFrame:
    """Incremental CSV: new files are new increments; the checkpoint replaces an offset counter."""
    return (
        spark.readStream.schema(schema).option("header", True).option("maxFilesPerTrigger", files_per_trigger).csv(folder)
    )


def message_file_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """A drop folder of JSON-lines messages ``{"topic": .., "value": ..}``."""
    schema = "topic string, value string"
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(folder)
    return raw.withColumn("arrived", F.current_timestamp())


def broker_stream(spark: SparkSession, servers: str, topics: str, **options: str) -> DataFrame:
    """Kafka topics as ``(topic, value, arrived)``; needs the Kafka connector on the classpath."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topics)
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.load().select(
        "topic", F.col("value").cast("string").alias("value"), F.col("timestamp").alias("arrived")
    )


def write_log(rows: DataFrame, path: str, checkpoint: str, **trigger):
    """Append every row to the durable log; this is the full buffer, with nothing trimmed."""
    return (
        rows.writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )
