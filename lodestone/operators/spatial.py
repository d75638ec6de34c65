"""Spatial joins on points and boxes: every distance or box condition becomes an equi-join on grid cells.

Frames have columns id, x and y, besides whatever else they hold. Columns of the right side get a suffix.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import geometry as geo
from lodestone.functions.equations import euclidean
from lodestone.scratch import checked_broadcast, spread, written


def _cell(v: Column, size: float) -> Column:
    return F.floor(v / size).cast("long")


def suffixed(df: DataFrame, suffix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{c}_{suffix}") for c in df.columns])


def within_distance_pairs(left: DataFrame, right: DataFrame, distance: float, suffix: str = "right") -> DataFrame:
    """All pairs at most distance apart, with distance. The left side goes to its 3 x 3 cells, so each pair meets once."""
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    a = left.withColumn("_o", around).withColumn("_cx", _cell(F.col("x"), distance) + F.col("_o.i")).withColumn("_cy", _cell(F.col("y"), distance) + F.col("_o.j")).drop("_o")
    b = suffixed(right, suffix)
    b = b.withColumn("_cx", _cell(F.col(f"x_{suffix}"), distance)).withColumn("_cy", _cell(F.col(f"y_{suffix}"), distance))
    pairs = a.join(b, ["_cx", "_cy"]).drop("_cx", "_cy")
    pairs = pairs.withColumn("distance", euclidean(F.col("x"), F.col("y"), F.col(f"x_{suffix}"), F.col(f"y_{suffix}")))
    return pairs.filter(F.col("distance") <= distance)


def all_pairs(left: DataFrame, right: DataFrame, suffix: str = "right") -> DataFrame:
    """Every left row with every right row, without a shuffle of pairs. Left rows are dealt out by the number of their pairs; a right side that is small goes to every task, a larger one is read again by each. Both are tables of their own."""
    left, right = written(left), written(right)
    return spread(left, left.count() * right.count()).crossJoin(checked_broadcast(suffixed(right, suffix), 16 + 16 * len(right.columns)))


def proximity_join(left: DataFrame, right: DataFrame, distance: float, how: str = "inner", suffix: str = "right") -> DataFrame:
    """within_distance_pairs; "left" keeps left rows without a partner, with nulls."""
    pairs = within_distance_pairs(left, right, distance, suffix)
    if how == "inner":
        return pairs
    alone = left.join(pairs.select("id").distinct(), "id", "left_anti")
    return pairs.unionByName(alone, allowMissingColumns=True)


def nearest_join(left: DataFrame, right: DataFrame, k: int = 1, how: str = "inner", max_distance: float | None = None, suffix: str = "right", exclude_self: bool = False) -> DataFrame:
    """The k nearest right rows of each left row, with distance and rank; ties by the right id as text.

    Cells of a size that should hold a few points are searched; a row whose k-th partner lies within the size is done, the
    others go on with twice the size, up to max_distance, whose search is the last.
    """
    order = Window.partitionBy("id").orderBy("distance", F.col(f"id_{suffix}").cast("string"))

    def ranked(rows: DataFrame, size: float) -> DataFrame:
        pairs = within_distance_pairs(rows, right, size, suffix)
        if exclude_self:
            pairs = pairs.filter(F.col("id") != F.col(f"id_{suffix}"))
        return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    # A table of its own, so that no round works out again where its points came from.
    right = written(right)
    left = right if exclude_self and left is right else written(left)
    box = right.unionByName(left.select("x", "y"), allowMissingColumns=True).agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).head()
    n = right.count()
    if n == 0 or box[0] is None:
        out = ranked(left, 1.0 if max_distance is None else max_distance)
    else:
        span = max(box[1] - box[0], box[3] - box[2], 1e-9)
        # About a dozen points more than needed in the nine cells around a point, if points lay evenly.
        size, todo, done = max(span * ((k + 4) / n) ** 0.5, 1e-9), left, []
        most = 2 * span if max_distance is None else min(2 * span, max_distance)
        while True:
            size = size if max_distance is None else min(size, max_distance)
            found = written(ranked(todo, size))
            if size >= most:
                done.append(found)
                break
            full = found.filter(F.col("rank") == k).select("id")
            done.append(found.join(full, "id", "left_semi"))
            todo = written(todo.join(full, "id", "left_anti"))
            if todo.isEmpty():
                break
            size *= 2
        out = reduce(DataFrame.unionByName, done)
    if how == "left":
        out = out.unionByName(left.join(out.select("id").distinct(), "id", "left_anti"), allowMissingColumns=True)
    return out


def assign_nearest(providers: DataFrame, targets: DataFrame, max_distance: float | None = None) -> DataFrame:
    """Each target with its nearest provider."""
    return nearest_join(targets, providers, 1, max_distance=max_distance, suffix="provider")


def rollup(left: DataFrame, pairs: DataFrame, suffix: str, sums: list[str] = (), means: list[str] = ()) -> DataFrame:
    """left with count, ids and aggregates of its partners; rows without any have 0 and an empty list."""
    aggs = [F.count("*").alias("n"), F.sort_array(F.collect_list(f"id_{suffix}")).alias("ids")]
    aggs += [F.sum(f"{c}_{suffix}").alias(f"{c}_sum") for c in sums] + [F.avg(c).alias(f"{c}_mean") for c in means]
    out = left.join(pairs.groupBy("id").agg(*aggs), "id", "left")
    return out.withColumn("n", F.coalesce("n", F.lit(0).cast("long"))).withColumn("ids", F.coalesce("ids", F.array().cast(out.schema["ids"].dataType)))


def catchment_competition(providers: DataFrame, targets: DataFrame, distance: float) -> DataFrame:
    """id, exclusive, contested, total: targets within reach of each provider alone, or of others too."""
    pairs = within_distance_pairs(providers, targets, distance, "target").select("id", "id_target")
    shared = pairs.groupBy("id_target").agg(F.count("*").alias("c"))
    counted = pairs.join(shared, "id_target").groupBy("id").agg(F.sum((F.col("c") == 1).cast("long")).alias("exclusive"), F.sum((F.col("c") > 1).cast("long")).alias("contested"), F.count("*").alias("total"))
    zero = F.lit(0).cast("long")
    return providers.select("id").join(counted, "id", "left").select("id", *[F.coalesce(c, zero).alias(c) for c in ("exclusive", "contested", "total")])


def box_filter(df: DataFrame, min_x: float, min_y: float, max_x: float, max_y: float) -> DataFrame:
    """Four comparisons that reach the Parquet scan where x and y are stored."""
    return df.filter(F.col("x").between(min_x, max_x) & F.col("y").between(min_y, max_y))


def radius_filter(df: DataFrame, x: float, y: float, radius: float) -> DataFrame:
    d = euclidean(F.col("x"), F.col("y"), F.lit(x), F.lit(y))
    return box_filter(df, x - radius, y - radius, x + radius, y + radius).withColumn("distance", d).filter(F.col("distance") <= radius)


def box_join(points: DataFrame, boxes: DataFrame, cell: float, suffix: str = "zone") -> DataFrame:
    """Points with the boxes (id, min_x, min_y, max_x, max_y) that hold them, sides included. Boxes go to the cells they cover."""
    z = suffixed(boxes, suffix)
    span = lambda a, b: F.explode(F.sequence(_cell(F.col(f"{a}_{suffix}"), cell), _cell(F.col(f"{b}_{suffix}"), cell)))
    z = z.withColumn("_cx", span("min_x", "max_x")).withColumn("_cy", span("min_y", "max_y"))
    p = points.withColumn("_cx", _cell(F.col("x"), cell)).withColumn("_cy", _cell(F.col("y"), cell))
    inside = F.col("x").between(F.col(f"min_x_{suffix}"), F.col(f"max_x_{suffix}")) & F.col("y").between(F.col(f"min_y_{suffix}"), F.col(f"max_y_{suffix}"))
    return p.join(z, ["_cx", "_cy"]).filter(inside).drop("_cx", "_cy")


def interval_join(left: DataFrame, right: DataFrame, key: str, lo: str, hi: str, bucket: float, suffix: str = "right") -> DataFrame:
    """Pairs of one key whose half-open intervals overlap. Both go to the buckets they touch; a pair counts in its first common one."""
    put = lambda df, a, b: df.withColumn("_b", F.explode(F.sequence(F.floor(F.col(a) / bucket), F.floor(F.col(b) / bucket))))
    a, r = put(left, lo, hi), suffixed(right, suffix)
    r = put(r, f"{lo}_{suffix}", f"{hi}_{suffix}").withColumnRenamed("_b", "_b2")
    on = (F.col(key) == F.col(f"{key}_{suffix}")) & (F.col("_b") == F.col("_b2"))
    first = F.col("_b") == F.greatest(F.floor(F.col(lo) / bucket), F.floor(F.col(f"{lo}_{suffix}") / bucket))
    return a.join(r, on).filter((F.col(lo) < F.col(f"{hi}_{suffix}")) & (F.col(f"{lo}_{suffix}") < F.col(hi)) & first).drop("_b", "_b2")


def _renamed(left: DataFrame, right: DataFrame, lsuffix: str, rsuffix: str) -> tuple[DataFrame, DataFrame]:
    clash = set(left.columns) & set(right.columns)
    return tuple(df.withColumnsRenamed({c: f"{c}_{s}" for c in df.columns if c in clash}) for df, s in ((left, lsuffix), (right, rsuffix)))


def _boxed(df: DataFrame, g: str, name: str) -> DataFrame:
    return df.withColumn(name, geo.bounds(F.col(g)))


def geometry_join(left: DataFrame, right: DataFrame, lg: str = "geometry", rg: str = "geometry", predicate: str = "intersects", how: str = "inner", cell: float | None = None, lsuffix: str = "left", rsuffix: str = "right", within: float = 0.0) -> DataFrame:
    """Rows of both sides whose geometries meet a predicate of functions.geometry (intersects, within, contains, covers, covered_by, equals).

    Each geometry goes to the grid cells that its bounds cover; a pair whose bounds meet is tested once, in the cell of the
    greater lower corner. cell: the grid's size, by default twice the mean extent of the larger side. Columns of one name get
    suffixes. "left" keeps left rows without a partner, with nulls. within widens the left bounds, for distance predicates.
    """
    a, b = _renamed(left, right, lsuffix, rsuffix)
    lg, rg = (f"{lg}_{lsuffix}", f"{rg}_{rsuffix}") if lg in right.columns and lg == rg else (lg, rg)
    a, b = _boxed(a, lg, "_a"), _boxed(b, rg, "_b")
    if cell is None:
        extent = lambda df, c: df.select(F.avg(F.greatest(F.col(f"{c}.max_x") - F.col(f"{c}.min_x"), F.col(f"{c}.max_y") - F.col(f"{c}.min_y")))).head()[0] or 0.0
        cell = max(2 * max(extent(a, "_a"), extent(b, "_b")) + within, 1e-6)
    a = a.withColumn("_lid", F.monotonically_increasing_id()) if how == "left" else a
    a = written(a) if how == "left" else a
    spread = lambda df, c, d: df.withColumn("_cx", F.explode(F.sequence(_cell(F.col(f"{c}.min_x") - d, cell), _cell(F.col(f"{c}.max_x") + d, cell)))).withColumn("_cy", F.explode(F.sequence(_cell(F.col(f"{c}.min_y") - d, cell), _cell(F.col(f"{c}.max_y") + d, cell))))
    near = (F.col("_a.min_x") - within <= F.col("_b.max_x")) & (F.col("_a.max_x") + within >= F.col("_b.min_x")) & (F.col("_a.min_y") - within <= F.col("_b.max_y")) & (F.col("_a.max_y") + within >= F.col("_b.min_y"))
    once = (F.col("_cx") == _cell(F.greatest(F.col("_a.min_x") - within, F.col("_b.min_x")), cell)) & (F.col("_cy") == _cell(F.greatest(F.col("_a.min_y") - within, F.col("_b.min_y")), cell))
    pairs = spread(a, "_a", within).join(spread(b, "_b", 0.0), ["_cx", "_cy"]).filter(near & once)
    test = geo.PREDICATES[predicate](F.col(lg), F.col(rg)) if predicate in geo.PREDICATES else F.lit(True)
    pairs = pairs.filter(test).drop("_cx", "_cy", "_a", "_b")
    if how == "left":
        alone = a.join(pairs.select("_lid").distinct(), "_lid", "left_anti").drop("_a")
        return pairs.unionByName(alone, allowMissingColumns=True).drop("_lid")
    return pairs


def buffer_join(left: DataFrame, right: DataFrame, distance: float, geometry: str = "geometry", sides: int = 64, how: str = "inner") -> DataFrame:
    """Left rows, points with a circle about each as geometry, and the right geometries that meet it."""
    v = geo.vertices(F.col(geometry))[0]
    return geometry_join(left.withColumn(geometry, geo.circle(v["x"], v["y"], distance, sides)), right, geometry, geometry, "intersects", how)


def corridor_reach(corridors: DataFrame, targets: DataFrame, distance: float, geometry: str = "geometry", suffix: str = "reach") -> DataFrame:
    """Targets that meet a corridor or whose centroid lies within distance of the corridor's."""
    met = geometry_join(corridors, targets, geometry, geometry, "intersects", rsuffix=suffix, lsuffix="corridor")
    a, b = _renamed(corridors, targets, "corridor", suffix)
    ca, cb = geo.centroid(F.col(f"{geometry}_corridor")), geo.centroid(F.col(f"{geometry}_{suffix}"))
    left = a.withColumn("_c", ca).withColumn("x", F.col("_c.x")).withColumn("y", F.col("_c.y")).drop("_c")
    right = b.withColumn("_c", cb).withColumn("x", F.col("_c.x")).withColumn("y", F.col("_c.y")).drop("_c")
    close = within_distance_pairs(left, right.withColumnsRenamed({}), distance, "t")
    close = close.select(*a.columns, *[F.col(f"{c}_t").alias(c) for c in b.columns])
    return met.select(*a.columns, *b.columns).unionByName(close).distinct()


def polygon_neighbors(polygons: DataFrame, id_col: str = "id", geometry: str = "geometry") -> DataFrame:
    """Pairs of ids (the smaller first) whose polygons touch or overlap."""
    pairs = geometry_join(polygons.select(id_col, geometry), polygons.select(id_col, geometry), geometry, geometry)
    a, b = F.col(f"{id_col}_left"), F.col(f"{id_col}_right")
    return pairs.filter(a < b).select(a.alias("a"), b.alias("b"))


def overlay_summary(left: DataFrame, right: DataFrame, id_col: str = "id", geometry: str = "geometry") -> DataFrame:
    """id and how many right geometries each left one meets."""
    met = geometry_join(left.select(id_col, geometry), right.select(F.col(geometry)), geometry, geometry).groupBy(id_col).agg(F.count("*").alias("n"))
    return left.select(id_col).join(met, id_col, "left").select(id_col, F.coalesce("n", F.lit(0)).alias("n"))


def rectangle_overlaps(left: DataFrame, right: DataFrame, cell: float) -> DataFrame:
    """Pairs of boxes (id, min_x, ...) that overlap, with the common box and its area: overlay_intersections, tabulate_intersection and clip of rectangles."""
    boxes = lambda df: df.withColumn("geometry", geo.rectangle(F.col("min_x"), F.col("min_y"), F.col("max_x"), F.col("max_y")))
    pairs = geometry_join(boxes(left), boxes(right), predicate="any", cell=cell)
    out = pairs.select("id_left", "id_right", *[f(f"{c}_left", f"{c}_right").alias(c) for c, f in (("min_x", F.greatest), ("min_y", F.greatest), ("max_x", F.least), ("max_y", F.least))])
    return out.withColumn("area", (F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y"))).filter("max_x > min_x and max_y > min_y")
