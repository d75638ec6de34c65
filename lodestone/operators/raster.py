"""Map algebra on rasters held as cells (row, col, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def algebra(a: DataFrame, b: DataFrame, f) -> DataFrame:
    """f(value of a, value of b) where both have a cell."""
    return a.withColumnRenamed("value", "_a").join(b.withColumnRenamed("value", "_b"), ["row", "col"]).select("row", "col", f(F.col("_a"), F.col("_b")).alias("value"))


def focal(cells: DataFrame, radius: int, agg=F.avg) -> DataFrame:
    """agg over the square window around each cell; cells go to their neighbours' places, so nothing but an aggregation shuffles."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1)])
    spread = cells.withColumn("o", F.explode(steps)).select((F.col("row") + F.col("o.i")).alias("row"), (F.col("col") + F.col("o.j")).alias("col"), "value", ((F.col("o.i") == 0) & (F.col("o.j") == 0)).alias("own"))
    return spread.groupBy("row", "col").agg(agg("value").alias("value"), F.max("own").alias("own")).filter("own").drop("own")


def block(cells: DataFrame, size: int, agg=F.avg) -> DataFrame:
    return cells.groupBy(F.floor(F.col("row") / size).alias("row"), F.floor(F.col("col") / size).alias("col")).agg(agg("value").alias("value"))


def zonal(cells: DataFrame, zones: DataFrame) -> DataFrame:
    """count, sum, mean, min and max of the cells of each zone. zones: row, col, zone."""
    return cells.join(zones, ["row", "col"]).groupBy("zone").agg(F.count("*").alias("count"), F.sum("value").alias("sum"), F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"))


def normalized_difference(a: Column, b: Column) -> Column:
    return F.when(a + b != 0, (a - b) / (a + b)).otherwise(F.lit(0.0))


def reclassify(value: Column, breaks: list[float]) -> Column:
    """Class from 0: how many breaks lie at or under the value."""
    return sum([(value >= b).cast("long") for b in breaks], F.lit(0).cast("long"))


# Neighbourhoods of three by three cells.

_STEPS = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 0), (0, 1), (1, -1), (1, 0), (1, 1)]
#: D8 directions from 1, clockwise from north, and what a diagonal step counts.
D8 = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]
DIAGONAL = 1.414


def around(cells: DataFrame) -> DataFrame:
    """row, col and z1 to z9, the values of the cell and its neighbours in reading order (null where there is none), by one aggregation."""
    places = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for k, (i, j) in enumerate(_STEPS, 1)]))
    spread = cells.select("row", "col", "value", places.alias("o")).select((F.col("row") - F.col("o.i")).alias("row"), (F.col("col") - F.col("o.j")).alias("col"), F.col("o.k").alias("k"), "value")
    out = spread.groupBy("row", "col").agg(*[F.max(F.when(F.col("k") == k, F.col("value"))).alias(f"z{k}") for k in range(1, 10)], F.max(F.col("k") == 5).alias("own"))
    return out.filter("own").drop("own")


def slope_aspect(cells: DataFrame, width: float = 1.0, height: float = 1.0) -> DataFrame:
    """slope (rise over run) and aspect (degrees) by Horn's differences; 0 where a neighbour is missing."""
    z = lambda k: F.col(f"z{k}")
    dx = ((z(3) + 2 * z(6) + z(9)) - (z(1) + 2 * z(4) + z(7))) / (8 * width)
    dy = ((z(7) + 2 * z(8) + z(9)) - (z(1) + 2 * z(2) + z(3))) / (8 * height)
    a = F.degrees(F.atan2(dy, -dx))
    out = around(cells).select("row", "col", F.sqrt(dx * dx + dy * dy).alias("slope"), F.when(a < 0, a + 360).otherwise(a).alias("aspect"))
    return out.fillna(0.0, ["slope", "aspect"])


def hillshade(cells: DataFrame, azimuth: float = 315.0, altitude: float = 45.0, width: float = 1.0, height: float = 1.0) -> DataFrame:
    """Brightness from 0 to 255."""
    from math import cos, radians, sin

    s, a = F.atan(F.col("slope")), F.radians(F.col("aspect"))
    value = 255 * (F.cos(s) * cos(radians(altitude)) + F.sin(s) * sin(radians(altitude)) * F.cos(F.lit(radians(azimuth)) - a))
    return slope_aspect(cells, width, height).select("row", "col", F.greatest(F.lit(0.0), F.least(F.lit(255.0), value)).alias("value"))


def ruggedness(cells: DataFrame) -> DataFrame:
    """Root of the squared differences to the eight neighbours; 0 where one is missing."""
    total = sum((F.pow(F.col(f"z{k}") - F.col("z5"), 2) for k in range(1, 10) if k != 5), F.lit(0.0))
    return around(cells).select("row", "col", F.coalesce(F.sqrt(total), F.lit(0.0)).alias("value"))


def curvature(cells: DataFrame, kind: str = "total", size: float = 1.0) -> DataFrame:
    """total, plan (across) or profile (down) second differences; 0 at the border."""
    d, e = (F.col("z2") + F.col("z8") - 2 * F.col("z5")) / (size * size), (F.col("z6") + F.col("z4") - 2 * F.col("z5")) / (size * size)
    whole = sum((F.col(f"z{k}") for k in range(1, 10)), F.lit(0.0)).isNotNull()
    return around(cells).select("row", "col", F.when(whole, {"plan": e, "profile": d, "total": d + e}[kind]).otherwise(F.lit(0.0)).alias("value"))


def flow_direction(cells: DataFrame) -> DataFrame:
    """value 1 to 8, the direction (clockwise from north) of the steepest drop to a neighbour, the first of equals; 0 if all lie over 1 higher."""
    number = {step: k for k, step in enumerate(_STEPS, 1)}
    drop = lambda step: (F.col("z5") - F.col(f"z{number[step]}")) / (DIAGONAL if abs(step[0]) + abs(step[1]) == 2 else 1.0)
    best = F.array_max(F.filter(F.array(*[F.struct(drop(s).alias("drop"), F.lit(-i).alias("way")) for i, s in enumerate(D8, 1)]), lambda x: x["drop"] > -1))
    return around(cells).select("row", "col", F.coalesce(-best["way"], F.lit(0)).alias("value"))


def downstream(directions: DataFrame) -> DataFrame:
    """Edges (src, dst as structs of row and col) from each cell to the one that it flows to."""
    step = F.element_at(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in D8]), F.col("value"))
    return directions.filter("value > 0").select(F.struct("row", "col").alias("src"), F.struct((F.col("row") + step["i"]).alias("row"), (F.col("col") + step["j"]).alias("col")).alias("dst"))


def cost_distance(cells: DataFrame, sources: DataFrame) -> DataFrame:
    """row, col and the least cost from source cells (row, col): entering a cell costs its value, times 1.414 diagonally."""
    from . import network

    ways = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(DIAGONAL if i and j else 1.0).alias("f")) for i, j in D8]))
    into = cells.select("row", "col", "value", ways.alias("o")).select(F.struct((F.col("row") + F.col("o.i")).alias("row"), (F.col("col") + F.col("o.j")).alias("col")).alias("src"), F.struct("row", "col").alias("dst"), (F.col("value") * F.col("o.f")).alias("cost"))
    edges = into.join(cells.select(F.struct("row", "col").alias("src")), "src", "left_semi")
    costs = network.shortest_costs(edges, sources.select(F.struct("row", "col").alias("node")))
    return costs.groupBy("node").agg(F.min("cost").alias("value")).select("node.row", "node.col", "value")


# Cells by place and value.


def window(cells: DataFrame, row_start: int, row_end: int, col_start: int, col_end: int) -> DataFrame:
    return cells.filter((F.col("row") >= row_start) & (F.col("row") < row_end) & (F.col("col") >= col_start) & (F.col("col") < col_end))


def tiles(cells: DataFrame, rows: int, cols: int) -> DataFrame:
    """cells with tile_row and tile_col."""
    return cells.withColumn("tile_row", F.floor(F.col("row") / rows)).withColumn("tile_col", F.floor(F.col("col") / cols))


def mosaic(rasters: list[DataFrame]) -> DataFrame:
    """Every cell of any raster; of several, that of the first."""
    rows = None
    for k, r in enumerate(rasters):
        r = r.select("row", "col", "value", F.lit(k).alias("k"))
        rows = r if rows is None else rows.unionByName(r)
    return rows.groupBy("row", "col").agg(F.min_by("value", "k").alias("value"))


def resample_average(cells: DataFrame, factor: int) -> DataFrame:
    """To cells factor times as large, by means (upscaling)."""
    return block(cells, factor)


def resample_nearest(cells: DataFrame, factor: int) -> DataFrame:
    """To cells a factor-th as large, each with its cell's value (downscaling)."""
    inner = lambda c: F.explode(F.sequence(F.col(c) * factor, F.col(c) * factor + factor - 1))
    return cells.withColumn("row", inner("row")).withColumn("col", inner("col"))


def histogram(cells: DataFrame, bins: int = 20) -> DataFrame:
    """bin, count and bounds of equal bins over the values' range."""
    one = F.broadcast(cells.agg(F.min("value").alias("lo"), F.max("value").alias("hi")))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(F.lit(0))
    step = (F.col("hi") - F.col("lo")) / bins
    return cells.filter("value is not null").crossJoin(one).groupBy(at.cast("long").alias("bin"), "lo", "hi").agg(F.count("*").alias("count")).select("bin", "count", (F.col("lo") + step * F.col("bin")).alias("from"), (F.col("lo") + step * (F.col("bin") + 1)).alias("to"))


def inspect(cells: DataFrame) -> DataFrame:
    """height, width, cells, nodata, min, max and mean."""
    return cells.agg((F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width"), F.count("*").alias("cells"), F.count_if(F.col("value").isNull()).alias("nodata"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"))


def changes(before: DataFrame, after: DataFrame, threshold: float = 0.0) -> DataFrame:
    """increased, decreased and unchanged cells, and the mean difference."""
    both = before.withColumnRenamed("value", "_a").join(after.withColumnRenamed("value", "_b"), ["row", "col"])
    d = F.col("_b") - F.col("_a")
    return both.agg(F.count_if(d > threshold).alias("increased"), F.count_if(d < -threshold).alias("decreased"), F.count_if(F.abs(d) <= threshold).alias("unchanged"), F.avg(d).alias("mean_difference"))


def cut_fill(before: DataFrame, after: DataFrame, cell_area: float = 1.0) -> DataFrame:
    """Volumes taken away, put on and net."""
    both = before.withColumnRenamed("value", "_a").join(after.withColumnRenamed("value", "_b"), ["row", "col"])
    d = F.col("_b") - F.col("_a")
    cut, fill = F.sum(F.greatest(F.lit(0.0), -d)) * cell_area, F.sum(F.greatest(F.lit(0.0), d)) * cell_area
    return both.agg(cut.alias("cut"), fill.alias("fill"), (fill - cut).alias("net"))


def sampled(cells: DataFrame, points: DataFrame, min_x: float, max_y: float, width: float, height: float) -> DataFrame:
    """points with the value of the cell that holds them, null outside."""
    p = points.withColumn("row", F.floor((max_y - F.col("y")) / height).cast("long")).withColumn("col", F.floor((F.col("x") - min_x) / width).cast("long"))
    return p.join(cells.withColumnRenamed("value", "raster_value"), ["row", "col"], "left").drop("row", "col")


def rasterized(points: DataFrame, cell: float, agg=F.count) -> DataFrame:
    """row and col of a grid from the origin, and agg of the points' v in each cell that has any."""
    return points.groupBy(F.floor(F.col("y") / cell).cast("long").alias("row"), F.floor(F.col("x") / cell).cast("long").alias("col")).agg(agg("v").alias("value"))


# Landscapes: cells whose value is a class.


def shannon(cells: DataFrame) -> DataFrame:
    """shannon and simpson diversity of the classes."""
    total = F.broadcast(cells.agg(F.count("*").alias("_t")))
    p = F.col("n") / F.col("_t")
    return cells.groupBy("value").agg(F.count("*").alias("n")).crossJoin(total).agg((-F.sum(p * F.log(p))).alias("shannon"), (1 - F.sum(p * p)).alias("simpson"))


def edge_density(cells: DataFrame, size: float = 1.0) -> DataFrame:
    """Length of the borders between unlike neighbours over the area."""
    next_ = lambda i, j: cells.select((F.col("row") - i).alias("row"), (F.col("col") - j).alias("col"), F.col("value").alias("_v"))
    unlike = lambda i, j: cells.join(next_(i, j), ["row", "col"]).agg(F.count_if(F.col("value") != F.col("_v")).alias("n"))
    area = cells.agg((F.count("*") * (size * size)).alias("area"))
    return unlike(0, 1).unionByName(unlike(1, 0)).agg((F.sum("n") * size).alias("length")).crossJoin(area).select((F.col("length") / F.col("area")).alias("edge_density"))


def patches(cells: DataFrame) -> DataFrame:
    """row, col, value and patch: the least cell of those of one class that join by their sides."""
    from . import network

    me = F.struct("row", "col")
    next_ = lambda i, j: cells.select((F.col("row") - i).alias("row"), (F.col("col") - j).alias("col"), F.col("value").alias("_v"))
    joined = lambda i, j: cells.join(next_(i, j), ["row", "col"]).filter("value = _v").select(me.alias("src"), F.struct((F.col("row") + i).alias("row"), (F.col("col") + j).alias("col")).alias("dst"))
    found = network.components(joined(0, 1).unionByName(joined(1, 0)).unionByName(cells.select(me.alias("src"), me.alias("dst"))))
    return found.select("node.row", "node.col", F.col("component").alias("patch")).join(cells, ["row", "col"])


def patch_areas(cells: DataFrame, cell_area: float = 1.0) -> DataFrame:
    """class, n_cells and area of each patch."""
    return patches(cells).groupBy("patch").agg(F.first("value").alias("class"), F.count("*").alias("n_cells")).select("class", "n_cells", (F.col("n_cells") * cell_area).alias("area"))
