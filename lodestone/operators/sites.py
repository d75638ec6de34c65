"""Sites and what lies about them: counts, sums and shares within a radius, inventories by type. Frames have id, x and y; no pair of all rows is made."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spatial import nearest_join, within_distance_pairs


def count_within(sites: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """id and n, the points within a radius (linked incidents, affected easements, cases of a zone)."""
    n = within_distance_pairs(sites.select("id", "x", "y"), points.select("id", "x", "y"), radius, "p").groupBy("id").agg(F.count("*").alias("n"))
    return sites.select("id").join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


def sum_within(sites: DataFrame, points: DataFrame, radius: float, weight: str) -> DataFrame:
    """id and total, the sum of a weight of the points within a radius (charging demand, small cells, population served)."""
    pairs = within_distance_pairs(sites.select("id", "x", "y"), points.select("id", "x", "y", F.col(weight).alias("w")), radius, "p")
    total = pairs.groupBy("id").agg(F.sum("w_p").alias("total"))
    return sites.select("id").join(total, "id", "left").select("id", F.coalesce("total", F.lit(0.0)).alias("total"))


def served_share(points: DataFrame, sites: DataFrame, radius: float, weight: str) -> DataFrame:
    """total and served weight, and the share served, of points with any site within a radius (park access, testing sites)."""
    near = within_distance_pairs(points.select("id", "x", "y"), sites.select("id", "x", "y"), radius, "s").select("id").distinct().withColumn("_in", F.lit(True))
    w = F.col(weight)
    rows = points.join(near, "id", "left")
    return rows.agg(F.sum(w).alias("total"), F.sum(F.when(F.col("_in"), w).otherwise(F.lit(0.0))).alias("served")).withColumn("share", F.when(F.col("total") > 0, F.col("served") / F.col("total")).otherwise(F.lit(0.0)))


def exposure(points: DataFrame, sources: DataFrame, radius: float, rate: float = 0.001) -> DataFrame:
    """id and the sum of intensity * exp(-rate * distance) of sources within a radius."""
    pairs = within_distance_pairs(points.select("id", "x", "y"), sources.select("id", "x", "y", "intensity"), radius, "s")
    total = pairs.groupBy("id").agg(F.sum(F.col("intensity_s") * F.exp(F.col("distance") * -rate)).alias("exposure"))
    return points.select("id").join(total, "id", "left").select("id", F.coalesce("exposure", F.lit(0.0)).alias("exposure"))


def nearest_site(points: DataFrame, sites: DataFrame) -> DataFrame:
    """Each point with its nearest site and the distance (supply chains, closest facilities in the plane)."""
    return nearest_join(points.select("id", "x", "y"), sites.select("id", "x", "y"), 1, suffix="site").select("id", "id_site", "distance")


def inventory(df: DataFrame, by: str, sums: list[str] = (), means: list[str] = ()) -> DataFrame:
    """Rows, sums and means of each type (poles, valves, trails, curbs, leases, parking, cultural resources and the like)."""
    return df.groupBy(by).agg(F.count("*").alias("n"), *[F.sum(c).alias(f"{c}_sum") for c in sums], *[F.avg(c).alias(f"{c}_mean") for c in means])


def compliance(df: DataFrame, test) -> DataFrame:
    """total, compliant and its share in per cent (ramps, plots, contributing properties)."""
    return df.agg(F.count("*").alias("total"), F.count_if(test).alias("compliant")).withColumn("pct", F.when(F.col("total") > 0, F.col("compliant") * 100 / F.col("total")).otherwise(F.lit(0.0)))


def equity(df: DataFrame, assessed: str, market: str) -> DataFrame:
    """n, median ratio of assessed to market value and coefficient of dispersion about it, in per cent."""
    r = df.filter(F.col(market) > 0).select((F.col(assessed) / F.col(market)).alias("r"))
    m = F.broadcast(r.agg(F.median("r").alias("m")))
    return r.crossJoin(m).agg(F.count("*").alias("n"), F.first("m").alias("median_ratio"), (F.avg(F.abs(F.col("r") - F.col("m"))) / F.first("m") * 100).alias("cod"))


def speeds(df: DataFrame, column: str) -> DataFrame:
    """n, mean, sample standard deviation and the 85th percentile of speeds."""
    return df.agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.percentile(F.col(column).cast("double"), F.lit(0.85)).alias("p85"))


def drift(baseline: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """Means of both and the difference, in standard deviations of the baseline."""
    b = baseline.agg(F.avg(column).alias("baseline_mean"), F.stddev_pop(column).alias("_s"))
    c = current.agg(F.avg(column).alias("current_mean"))
    return b.crossJoin(c).select("baseline_mean", "current_mean", F.when(F.col("_s") > 0, F.abs(F.col("current_mean") - F.col("baseline_mean")) / F.col("_s")).otherwise(F.lit(0.0)).alias("shift"))


def forecast_errors(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """n, mae, rmse and bias of predictions."""
    e = F.col(predicted) - F.col(actual)
    return df.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"))


def imputed(df: DataFrame, column: str) -> DataFrame:
    """df with nulls of a column replaced by its mean."""
    m = F.broadcast(df.agg(F.avg(column).alias("_m")))
    return df.crossJoin(m).withColumn(column, F.coalesce(column, "_m")).drop("_m")


def deduplicated(df: DataFrame, column: str, order: str) -> DataFrame:
    """The first row, by order, of each text without regard to case and outer space (addresses)."""
    key = F.lower(F.trim(F.col(column)))
    first = df.groupBy(key.alias("_k2")).agg(F.min(order).alias("_o"))
    return df.withColumn("_k", key).join(first, F.col("_k").eqNullSafe(F.col("_k2")) & (F.col(order) == F.col("_o")), "left_semi").drop("_k")


def matched(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """left with matched: whether right holds the name, without regard to case."""
    names = right.select(F.lower(F.col(column)).alias("_n")).distinct().withColumn("_y", F.lit(True))
    return left.join(names, F.lower(F.col(column)) == F.col("_n"), "left").withColumn("matched", F.coalesce("_y", F.lit(False))).drop("_n", "_y")


def pareto(df: DataFrame, cost: str, benefit: str) -> DataFrame:
    """Rows that no other beats on one of cost and benefit without losing on the other, by the best benefit of every cheaper cost."""
    from . import ordered

    tops = df.groupBy(F.col(cost).cast("double").alias("_c")).agg(F.max(benefit).cast("double").alias("_b"))
    best = ordered.running(tops, "_b", [F.col("_c")], "max", "_upto")
    before = ordered.difference(best.withColumn("_u", F.col("_upto")), "_u", [F.col("_c")], 1, name="_d").withColumn("_prev", F.col("_u") - F.col("_d"))
    kept = before.filter("_prev is null or _b > _prev").select("_c", "_b")
    return df.join(kept, (F.col(cost).cast("double") == F.col("_c")) & (F.col(benefit).cast("double") == F.col("_b"))).drop("_c", "_b")
