"""Relational operators on tables: joins, aggregation, ordered functions, reshaping, comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

AGGREGATES = {
    "sum": F.sum, "mean": F.avg, "median": F.median, "min": F.min, "max": F.max, "count": F.count, "unique_count": F.countDistinct,
    "std": F.stddev_pop, "var": F.var_pop, "first": F.first,
}


def merge(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", suffixes: tuple[str, str] = ("left", "right"), indicator: bool = False) -> DataFrame:
    """Inner or left equi-join in which null keys match; clashing columns of both sides get suffixes."""
    clash = {c for c in left.columns if c in right.columns} - set(on)
    a = left.select(*[F.col(c).alias(f"{c}_{suffixes[0]}" if c in clash else c) for c in left.columns])
    b = right.select(*[F.col(c).alias(f"_k_{c}" if c in on else f"{c}_{suffixes[1]}" if c in clash else c) for c in right.columns], F.lit(True).alias("_m"))
    match = None
    for c in on:
        match = F.col(c).eqNullSafe(F.col(f"_k_{c}")) if match is None else match & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    out = a.join(b, match, how).drop(*[f"_k_{c}" for c in on])
    if indicator:
        out = out.withColumn("_merge", F.when(F.col("_m"), "both").otherwise("left_only"))
    return out.drop("_m")


def group_agg(df: DataFrame, by: list[str], spec: dict[str, list[str]]) -> DataFrame:
    """Aggregates named column_operation, by AGGREGATES."""
    return df.groupBy(*by).agg(*[AGGREGATES[op](c).alias(f"{c}_{op}") for c, ops in spec.items() for op in ops])


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("count"))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each column: count, mean, std (population), min, max. One pass, then unpivoted."""
    stats = F.array(*[F.struct(F.lit(c).alias("column"), F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max")) for c in columns])
    return df.agg(stats.alias("s")).select(F.explode("s").alias("s")).select("s.*")


def pivot(df: DataFrame, index: str, column: str, values: list, value: str, agg: str = "sum") -> DataFrame:
    """values are given, so that no job is spent on finding them."""
    return df.groupBy(index).pivot(column, values).agg(AGGREGATES[agg](value))


def drop_duplicates(df: DataFrame, subset: list[str], order: list[Column], keep: str = "first") -> DataFrame:
    """One row of each subset: the first, or last, in order."""
    w = Window.partitionBy(*subset).orderBy(*(order if keep == "first" else [c.desc() for c in order]))
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def running(column: str, w: WindowSpec, how: str) -> Column:
    """Running sum, min, max, mean or product up to the row; a null row stays null for sum and product."""
    c, w = F.col(column), w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    f = {"sum": F.sum, "min": F.min, "max": F.max, "mean": F.avg, "prod": F.product, "std": F.stddev_pop}[how](c).over(w)
    return F.when(c.isNotNull(), f) if how in ("sum", "prod") else f


def difference(column: str, w: WindowSpec, periods: int = 1, relative: bool = False) -> Column:
    before = F.lag(column, periods).over(w)
    d = F.col(column) - before
    return F.when(before != 0, d / F.abs(before)) if relative else d


def rolling(column: str, w: WindowSpec, size: int, how: str = "mean", partial: bool = False) -> Column:
    """Over the last size rows; null until there are that many, unless partial."""
    f = {"sum": F.sum, "min": F.min, "max": F.max, "mean": F.avg, "std": F.stddev_pop}[how](column).over(w.rowsBetween(1 - size, 0))
    return f if partial else F.when(F.row_number().over(w) >= size, f)


def rank(column: str, partition: list[str], method: str = "average", ascending: bool = True) -> Column:
    w = Window.partitionBy(*partition).orderBy(F.col(column).asc() if ascending else F.col(column).desc())
    ties = F.count("*").over(Window.partitionBy(*partition, column))
    return {"min": F.rank().over(w), "max": F.rank().over(w) + ties - 1, "average": F.rank().over(w) + (ties - 1) / 2, "dense": F.rank().over(w), "true_dense": F.dense_rank().over(w), "first": F.row_number().over(w)}[method]


def compare(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key and status (added, removed, modified, identical) of every key on either side."""
    a = old.select(F.col(key), F.struct(*columns).alias("a"))
    b = new.select(F.col(key), F.struct(*columns).alias("b"))
    status = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a").eqNullSafe(F.col("b")), "identical").otherwise("modified")
    return a.join(b, key, "full").select(key, status.alias("status"))


def upsert(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    return target.join(source.select(key), key, "left_anti").unionByName(source)


def one_to_many(parent: DataFrame, child: DataFrame, parent_key: str, child_key: str, name: str) -> DataFrame:
    """parent with an array of its children, empty if there are none."""
    lists = child.groupBy(child_key).agg(F.collect_list(F.struct(*[c for c in child.columns if c != child_key])).alias(name))
    out = parent.join(lists, parent[parent_key] == lists[child_key], "left").drop(lists[child_key])
    return out.withColumn(name, F.coalesce(name, F.array().cast(out.schema[name].dataType)))
