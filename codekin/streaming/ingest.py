"""Structured Streaming over arriving prints and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def file_stream(spark: SparkSession, folder: str, schema, per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def windowed_counts(events: DataFrame, time: str, keys: list[str], width: str, late: str) -> DataFrame:
    """Rows per window and key; rows later than ``late`` behind the newest time are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def append_new_sets(prints: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch's (repo, hash) sets are appended under its number; writing a number again replaces it, so a repeated batch changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        batch.where("hash is not null and repo is not null").select("repo", "hash").distinct().write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return prints.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
