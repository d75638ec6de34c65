"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of rows that a join may broadcast; above it the join shuffles.
BROADCAST_BYTES = 32 << 20

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only where that is unset (local mode)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _OWN.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="lodestone-"))


def written(df: DataFrame) -> DataFrame:
    """df, written as Parquet and read again: rows stay the same, and a lost executor replays nothing from before."""
    path = f"{shared_folder(df.sparkSession)}/lodestone/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str, each: int = 1_000_000) -> DataFrame:
    """df with the rows of a key in one task, as windows need them, and about each rows in a task whatever the table's size. df is read to count it."""
    return df.repartition(max(1, -(-df.count() // each)), *keys)


def checked_broadcast(df: DataFrame, row_bytes: int) -> DataFrame:
    """df with a broadcast hint if its counted rows take at most BROADCAST_BYTES."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def spread(df: DataFrame, work: int, each: int = 50_000_000) -> DataFrame:
    """df dealt out anew, into a task for each so many of work's units (as pairs), at least one for each core while there are rows: a small file would otherwise be one task."""
    tasks = max(-(-work // each), min(df.sparkSession.sparkContext.defaultParallelism, -(-work // 1_000)))
    return df.repartition(min(tasks, 20_000)) if tasks > 1 else df
