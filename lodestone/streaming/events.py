"""Structured Streaming forms of the temporal operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Events from Parquet files as they arrive."""
    return spark.readStream.schema(schema).parquet(folder)


def windowed_counts(events: DataFrame, time: str, size: str, late: str, keys: list[str], slide: str | None = None) -> DataFrame:
    """Counts by window and keys; what comes later than late after the newest event is left out."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    out = events.withWatermark(time, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def deduplicated(events: DataFrame, time: str, key: str, late: str) -> DataFrame:
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
