"""Connected components by contraction: each round every vertex goes to its least neighbour in a fresh random order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """vertex, root for every vertex of edges (columns a and b, any type); equal roots mean connected. Nothing reaches the driver but counts."""
    edges = cut(edges.filter("a <> b").select("a", "b").distinct())
    labels = None
    turn = 0
    while turn == 0 or not edges.isEmpty():
        order = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("o"), c.alias("v"))  # noqa: E731, B023
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        goes = both.groupBy("a").agg(F.min(order(F.col("b"))).alias("least")).select(F.col("a").alias("v"), F.least(order(F.col("a")), "least")["v"].alias("to"))
        goes = cut(goes)
        # One more step along the pointers shortens what is left.
        far = goes.alias("x").join(goes.alias("y"), F.col("x.to") == F.col("y.v")).select(F.col("x.v").alias("v"), F.col("y.to").alias("to"))
        far = cut(far)
        if labels is None:
            labels = far.select(F.col("v").alias("vertex"), F.col("to").alias("root"))
        else:
            labels = cut(labels.join(far, labels["root"] == far["v"], "left").select("vertex", F.coalesce("to", "root").alias("root")))
        moved = edges.join(far, edges["a"] == far["v"]).select(F.col("to").alias("a"), "b")
        moved = moved.join(far, moved["b"] == far["v"]).select("a", F.col("to").alias("b"))
        edges = cut(moved.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        turn += 1
    return labels
