"""Streams: the same transforms over files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream(spark: SparkSession, path: str, like: DataFrame, files_at_once: int = 1) -> DataFrame:
    """Parquet files below path as a stream, with the schema of a table."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def first_seen(events: DataFrame, key: str, time: str, late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark: idempotent intake."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, time: str, by: str, window: str, late: str = "1 hour") -> DataFrame:
    """start, by, n per tumbling window; works on streams and tables."""
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")
