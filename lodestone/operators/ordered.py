"""Ordered functions over a whole table without putting it into one partition.

Rows get their number by a range partitioning, a sort of each partition and the counts of the partitions, which are few. A
running function is worked out within each partition and shifted by what the ones before it hold; a function of the last k
rows is worked out in blocks of numbered rows, each with a copy of the k rows before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.scratch import written

BLOCK = 65_536


def _parts(df: DataFrame, order: list[Column]) -> DataFrame:
    """df sorted over partitions of ascending ranges, with the partition's number in _part; written, so that it stays the same."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))


def numbered(df: DataFrame, order: list[Column], name: str = "_rn") -> DataFrame:
    """df with each row's number from 0 in order. Rows that order doesn't tell apart are numbered either way."""
    rows = _parts(df, order)
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    # One row a partition.
    before = counts.select(F.col("_part"), F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return rows.withColumn(name, local).join(F.broadcast(before), "_part").withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_before")


def running(df: DataFrame, column: str, order: list[Column], how: str = "sum", name: str | None = None) -> DataFrame:
    """df with the running sum, prod, min, max, mean or std of column. A null row stays null for sum and prod and keeps the value so far for the others."""
    name = name or f"{column}_{how}"
    c = F.col(column).cast("double")
    rows = _parts(df, order)
    w = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pieces = {
        "sum": {"s": F.sum(c)}, "prod": {"p": F.product(c)}, "min": {"m": F.min(c)}, "max": {"m": F.max(c)},
        "mean": {"s": F.sum(c), "n": F.count(c)}, "std": {"s": F.sum(c), "q": F.sum(c * c), "n": F.count(c)},
    }[how]
    across = {"s": F.sum, "q": F.sum, "n": F.sum, "p": F.product, "m": F.min if how == "min" else F.max}
    totals = rows.groupBy("_part").agg(*[f.alias(f"_{k}_all") for k, f in pieces.items()])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_part", *[across[k](f"_{k}_all").over(earlier).alias(f"_{k}_before") for k in pieces])
    rows = rows.select("*", *[f.over(w).alias(f"_{k}") for k, f in pieces.items()]).join(F.broadcast(totals), "_part")
    both = {}
    for k in pieces:
        a, b = F.col(f"_{k}_before"), F.col(f"_{k}")
        join = {"s": lambda x, y: x + y, "q": lambda x, y: x + y, "n": lambda x, y: x + y, "p": lambda x, y: x * y, "m": F.least if how == "min" else F.greatest}[k]
        both[k] = F.when(a.isNull(), b).when(b.isNull(), a).otherwise(join(a, b))
    if how in ("sum", "prod"):
        out = F.when(c.isNotNull(), both["s" if how == "sum" else "p"])
    elif how in ("min", "max"):
        out = both["m"]
    elif how == "mean":
        out = F.when(both["n"] > 0, both["s"] / both["n"])
    else:
        out = F.when(both["n"] > 0, F.sqrt(F.greatest(F.lit(0.0), both["q"] / both["n"] - F.pow(both["s"] / both["n"], 2))))
    return rows.withColumn(name, out).select(*df.columns, name)


def _with_before(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """Numbered rows in blocks, each with the k rows before it (marked by _own false)."""
    rows = numbered(df, order)
    block, at = F.floor(F.col("_rn") / BLOCK), F.col("_rn") % BLOCK
    extra = F.when(at >= BLOCK - k, F.array(block, block + 1)).otherwise(F.array(block))
    rows = rows.withColumn("_block", F.explode(extra))
    return rows.withColumn("_own", F.col("_block") == block)


def rolling(df: DataFrame, column: str, order: list[Column], size: int, how: str = "mean", name: str | None = None, partial: bool = False) -> DataFrame:
    """df with a function (mean, sum, min, max, std of the population) of the last size rows, size at most BLOCK; null until there are so many, unless partial."""
    w = Window.partitionBy("_block").orderBy("_rn").rowsBetween(1 - size, 0)
    c = F.col(column).cast("double")
    f = {"sum": F.sum, "min": F.min, "max": F.max, "mean": F.avg, "std": F.stddev_pop}[how](c).over(w)
    out = _with_before(df, order, size - 1).withColumn("_f", f if partial else F.when(F.col("_rn") >= size - 1, f))
    return out.filter("_own").select(*df.columns, F.col("_f").alias(name or f"{column}_{how}"))


def difference(df: DataFrame, column: str, order: list[Column], periods: int = 1, relative: bool = False, name: str | None = None) -> DataFrame:
    """df with the difference to the value periods rows before, as a share of its size if relative (null where that is 0)."""
    c = F.col(column).cast("double")
    before = F.lag(c, periods).over(Window.partitionBy("_block").orderBy("_rn"))
    d = F.when(before != 0, (c - before) / F.abs(before)) if relative else c - before
    out = _with_before(df, order, periods).withColumn("_f", d)
    return out.filter("_own").select(*df.columns, F.col("_f").alias(name or f"{column}_{'pct_change' if relative else 'diff'}"))


def filled(df: DataFrame, columns: list[str], order: list[Column]) -> DataFrame:
    """df with nulls replaced by the last value before in order."""
    rows = _parts(df, order)
    w = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows.select(*[c for c in df.columns if c not in columns], "_part", *[F.last(c, ignorenulls=True).over(w).alias(c) for c in columns], F.row_number().over(Window.partitionBy("_part").orderBy(*order)).alias("_at"))
    local = written(local)
    ends = local.groupBy("_part").agg(*[F.max_by(F.col(c), F.col("_at")).alias(c) for c in columns])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("_part", *[F.last(c, ignorenulls=True).over(earlier).alias(f"_{c}_before") for c in columns])
    out = local.join(F.broadcast(ends), "_part", "left")
    return out.select(*[F.coalesce(c, f"_{c}_before").alias(c) if c in columns else F.col(c) for c in df.columns])


def ranked(df: DataFrame, column: str, method: str = "average", ascending: bool = True, name: str = "rank") -> DataFrame:
    """df with the rank of column's values: average, min, max, dense (as min), true_dense; null for null.

    Values are counted first, and only the distinct ones are numbered.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_n"))
    order = F.col("_v").asc() if ascending else F.col("_v").desc()
    at = running(counts, "_n", [order], "sum", "_upto")
    if method == "true_dense":
        at = numbered(at, [order], "_dense")
    upto, n = F.col("_upto"), F.col("_n")
    rank = {"average": upto - (n - 1) / 2, "min": upto - n + 1, "max": upto, "dense": upto - n + 1, "true_dense": F.col("_dense") + 1}[method].cast("double")
    return df.join(at.select("_v", rank.alias(name)), F.col(column) == F.col("_v"), "left").drop("_v")
