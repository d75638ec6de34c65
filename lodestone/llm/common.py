"""Pieces that several training-data operators share: lineage cuts, size-checked broadcasts, byte views of Arrow columns."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of rows that a join may broadcast; above it the join shuffles.
BROADCAST_BYTES = 32 << 20

_OWN_DIR: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only where that is unset (local mode)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _OWN_DIR.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="lodestone-"))


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Sends at most rows rows to Python at a time from now on: batches of whole texts are large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def cut(df: DataFrame) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again, so that a lost executor never makes Spark replay what came before."""
    path = f"{shared_dir(df.sparkSession)}/lodestone/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def discard(*written: DataFrame) -> None:
    """Deletes the folders of DataFrames that cut() returned and that nothing reads any more."""
    for df in written:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._cut_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, row_bytes: int, rows: int | None = None) -> DataFrame:
    """df with a broadcast hint if its counted rows take at most BROADCAST_BYTES; else df itself, for a shuffled join."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n * row_bytes <= BROADCAST_BYTES else df


def fetched(rows: DataFrame, found: DataFrame, key: list[str], rest: bool = False):
    """rows joined with found on key; with rest, also the rows whose key found doesn't hold, or None if a left join has them.

    rows are wide and found holds few of their keys, mostly: found's keys are broadcast if they take at most BROADCAST_BYTES,
    so that only rows that it holds are shuffled; else all rows are.
    """
    if found.count() * 64 <= BROADCAST_BYTES:
        keys = F.broadcast(found.select(*key))
        held = rows.join(keys, key, "left_semi").join(found.hint("merge"), key)
        return (held, rows.join(keys, key, "left_anti")) if rest else held
    return (rows.join(found, key, "left"), None) if rest else rows.join(found, key)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def randoms(n: int, seed: int) -> np.ndarray:
    """n fixed odd 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def byte_view(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column, nulls as empty, and its n + 1 offsets."""
    import pyarrow as pa

    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    return data, offsets


def trim() -> None:
    """Gives what earlier work of this Python process left free back to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if give := getattr(ctypes.CDLL(None), "malloc_trim", None):
        give(0)


def lean(batches):
    """batches, with a trim before each and at the end, as workers are kept from stage to stage."""
    for batch in batches:
        trim()
        yield batch
    trim()


def slices(batch, name: str, most: int = 1 << 19):
    """The batch cut into runs of rows whose texts hold about most bytes, so that working arrays stay small."""
    _, offsets = byte_view(batch.column(name))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield batch.slice(i, min(j, n) - i)
        i = min(j, n)
