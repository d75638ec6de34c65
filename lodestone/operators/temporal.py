"""Operators on event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tumbling(events: DataFrame, time: str, size: str, keys: list[str], aggs: dict, slide: str | None = None) -> DataFrame:
    """start, end, keys and aggs (name: Column) of each window. The same plan serves a batch and a stream."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return events.groupBy(w.alias("w"), *keys).agg(*[c.alias(k) for k, c in aggs.items()]).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, *aggs)


def asof_nearest(left: DataFrame, right: DataFrame, time: str, key: str, tolerance_s: int, right_id: str) -> DataFrame:
    """Each left row with the right row of its key nearest in time, within a tolerance; ties by right_id. Times meet in buckets of the tolerance."""
    sec = lambda c: F.col(c).cast("double")
    a = left.withColumn("_b", F.explode(F.array(*[F.floor(sec(time) / tolerance_s) + i for i in (-1, 0, 1)])))
    b = right.select(*[F.col(c).alias(f"{c}_right") for c in right.columns]).withColumn("_b", F.floor(sec(f"{time}_right") / tolerance_s)).withColumnRenamed(f"{key}_right", key)
    gap = F.abs(sec(time) - sec(f"{time}_right"))
    pairs = a.join(b, [key, "_b"]).withColumn("gap", gap).filter(F.col("gap") <= tolerance_s)
    first = Window.partitionBy(*[c for c in left.columns]).orderBy("gap", f"{right_id}_right")
    return pairs.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n", "_b")


def sessions(events: DataFrame, time: str, key: str, gap: str) -> DataFrame:
    """Count of each session of a key; a session ends after a gap. Serves streams too."""
    return events.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
