"""Queries on rasters, landscapes and sites."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import raster, sites
from lodestone.plans.catalog import CELLS, DIST, POINTS, query

c = F.col
_Z = f"{CELLS}, z AS (SELECT a.row, a.col, " + ", ".join(f"max(CASE WHEN b.row = a.row + {i} AND b.col = a.col + {j} THEN b.value END) AS z{k}" for k, (i, j) in enumerate(raster._STEPS, 1)) + " FROM cells a JOIN cells b ON b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 GROUP BY 1, 2)"
_S = f"{_Z}, g AS (SELECT row, col, ((z3 + 2 * z6 + z9) - (z1 + 2 * z4 + z7)) / 8 AS dx, ((z7 + 2 * z8 + z9) - (z1 + 2 * z2 + z3)) / 8 AS dy FROM z), s AS (SELECT row, col, coalesce(sqrt(dx * dx + dy * dy), 0) AS slope, coalesce(CASE WHEN degrees(atan2(dy, -dx)) < 0 THEN degrees(atan2(dy, -dx)) + 360 ELSE degrees(atan2(dy, -dx)) END, 0) AS aspect FROM g)"


@query(f"WITH {_S} SELECT row, col, slope, aspect, greatest(0, least(255, 255 * (cos(radians(45)) * cos(atan(slope)) + sin(radians(45)) * sin(atan(slope)) * cos(radians(315) - radians(aspect))))) AS shade FROM s")
def slope_aspect_hillshade(t):
    return raster.slope_aspect(t.cells()).join(raster.hillshade(t.cells()).withColumnRenamed("value", "shade"), ["row", "col"])


@query(f"WITH {_Z} SELECT row, col, coalesce(sqrt(pow(z1 - z5, 2) + pow(z2 - z5, 2) + pow(z3 - z5, 2) + pow(z4 - z5, 2) + pow(z6 - z5, 2) + pow(z7 - z5, 2) + pow(z8 - z5, 2) + pow(z9 - z5, 2)), 0) AS rugged, CASE WHEN z1 + z2 + z3 + z4 + z5 + z6 + z7 + z8 + z9 IS NULL THEN 0 ELSE z2 + z8 - 2 * z5 + z6 + z4 - 2 * z5 END AS curve FROM z")
def ruggedness_curvature(t):
    return raster.ruggedness(t.cells()).withColumnRenamed("value", "rugged").join(raster.curvature(t.cells()).withColumnRenamed("value", "curve"), ["row", "col"])


_D = ", ".join(f"struct_pack(d := (z5 - z{dict((s, k) for k, s in enumerate(raster._STEPS, 1))[step]}) / {1.414 if abs(step[0]) + abs(step[1]) == 2 else 1.0}, w := -{i})" for i, step in enumerate(raster.D8, 1))


@query(f"WITH {_Z} SELECT row, col, coalesce(-(list_max(list_filter([{_D}], lambda x: x.d > -1)).w), 0) AS value FROM z")
def flow_direction(t):
    return raster.flow_direction(t.cells())


@query(f"WITH {CELLS} SELECT 'window' AS what, count(*) AS n, sum(value) AS total FROM cells WHERE row >= 3 AND row < 20 AND col >= 5 AND col < 30 UNION ALL SELECT 'tiles', count(DISTINCT (row // 16) * 100 + col // 16), sum(value) FROM cells UNION ALL SELECT 'up', count(*), sum(v) FROM (SELECT avg(value) AS v FROM cells GROUP BY row // 4, col // 4) UNION ALL SELECT 'down', count(*) * 4, sum(value) * 4 FROM cells UNION ALL SELECT 'mosaic', count(*), sum(value) FROM cells")
def raster_pieces(t):
    k = t.cells()
    one = lambda what, df: df.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.lit(what).alias("what"), "n", "total")
    tiles = raster.tiles(k, 16, 16).agg(F.countDistinct("tile_row", "tile_col").alias("n"), F.sum("value").alias("total")).select(F.lit("tiles").alias("what"), "n", "total")
    out = one("window", raster.window(k, 3, 20, 5, 30)).unionByName(tiles).unionByName(one("up", raster.resample_average(k, 4))).unionByName(one("down", raster.resample_nearest(k, 2)))
    return out.unionByName(one("mosaic", raster.mosaic([raster.window(k, 0, 40, 0, 64), k])))


@query(f"WITH {CELLS}, b AS (SELECT min(value) AS lo, max(value) AS hi FROM cells) SELECT least(floor((value - lo) / (hi - lo) * 10), 9)::BIGINT AS bin, count(*) AS count FROM cells, b GROUP BY 1")
def raster_histogram(t):
    return raster.histogram(t.cells(), 10).select("bin", "count")


@query(f"WITH {CELLS} SELECT max(row) + 1 AS height, max(col) + 1 AS width, count(*) AS cells, 0::BIGINT AS nodata, min(value) AS min, max(value) AS max, avg(value) AS mean FROM cells")
def raster_inspect(t):
    return raster.inspect(t.cells())


@query(f"WITH {CELLS}, d AS (SELECT (row % 3 - 1)::DOUBLE AS d FROM cells) SELECT count(*) FILTER (WHERE d > 0) AS increased, count(*) FILTER (WHERE d < 0) AS decreased, count(*) FILTER (WHERE d = 0) AS unchanged, count(*) FILTER (WHERE d < 0)::DOUBLE AS cut, count(*) FILTER (WHERE d > 0)::DOUBLE AS fill FROM d")
def raster_changes(t):
    k = t.cells().withColumn("value", F.lit(10.0))
    after = k.withColumn("value", c("value") + c("row") % 3 - 1)
    return raster.changes(k, after).drop("mean_difference").crossJoin(raster.cut_fill(k, after).drop("net"))


@query(f"WITH {CELLS}, k AS (SELECT floor(value / 10) AS v FROM cells), n AS (SELECT v, count(*) / sum(count(*)) OVER () AS p FROM k GROUP BY 1) SELECT -sum(p * ln(p)) AS shannon, 1 - sum(p * p) AS simpson FROM n")
def landscape_diversity(t):
    return raster.shannon(t.cells().withColumn("value", F.floor(c("value") / 10)))


@query(f"WITH {CELLS}, k AS (SELECT row, col, floor(value / 10) AS v FROM cells) SELECT (SELECT count(*) FROM k a JOIN k b ON a.v <> b.v AND ((b.row = a.row AND b.col = a.col + 1) OR (b.row = a.row + 1 AND b.col = a.col))) / (SELECT count(*) FROM k)::DOUBLE AS edge_density")
def landscape_edges(t):
    return raster.edge_density(t.cells().withColumn("value", F.floor(c("value") / 10)))


@query(f"WITH {POINTS}, j AS (SELECT a.id, b.v, {DIST} AS d FROM f a JOIN p b ON {DIST} <= 0.05) SELECT f.id, count(j.id) AS n, coalesce(sum(j.v), 0) AS total, coalesce(sum(j.v * exp(-0.001::DOUBLE * j.d)), 0) AS exposure FROM f LEFT JOIN j ON j.id = f.id GROUP BY 1")
def about_sites(t):
    f, p = t.facilities(), t.points()
    out = sites.count_within(f, p, 0.05).join(sites.sum_within(f, p, 0.05, "v"), "id")
    return out.join(sites.exposure(f, p.withColumn("intensity", c("v")), 0.05), "id")


@query(f"WITH {POINTS}, s AS (SELECT DISTINCT b.id FROM f a JOIN p b ON {DIST} <= 0.05) SELECT sum(v + 1) AS total, sum(CASE WHEN s.id IS NOT NULL THEN v + 1 ELSE 0 END) AS served, sum(CASE WHEN s.id IS NOT NULL THEN v + 1 ELSE 0 END) / sum(v + 1) AS share FROM p LEFT JOIN s ON s.id = p.id")
def served_share(t):
    return sites.served_share(t.points().withColumn("w", c("v") + 1), t.facilities(), 0.05, "w")


@query("SELECT p_brand, count(*) AS n, sum(p_size) AS p_size_sum, avg(p_retailprice) AS p_retailprice_mean FROM part GROUP BY 1")
def inventory(t):
    return sites.inventory(t.part, "p_brand", ["p_size"], ["p_retailprice"])


@query("WITH r AS (SELECT p_size / p_retailprice AS r FROM part), m AS (SELECT median(r) AS m FROM r) SELECT count(*) AS n, any_value(m) AS median_ratio, avg(abs(r - m)) / any_value(m) * 100 AS cod, (SELECT count(*) FROM part WHERE p_size > 25) * 100.0::DOUBLE / count(*) AS pct FROM r, m")
def equity(t):
    return sites.equity(t.part, "p_size", "p_retailprice").crossJoin(sites.compliance(t.part, c("p_size") > 25).select("pct"))


@query("SELECT count(value) AS n, avg(value) AS mean, stddev_samp(value) AS std, quantile_cont(value, 0.85) AS p85 FROM events")
def speeds(t):
    return sites.speeds(t.events, "value")


@query("SELECT count(*) AS n, avg(abs(l_tax - l_discount)) AS mae, sqrt(avg(pow(l_tax - l_discount, 2))) AS rmse, avg(l_tax - l_discount) AS bias FROM lineitem")
def forecast_errors(t):
    return sites.forecast_errors(t.lineitem, "l_discount", "l_tax")


@query("WITH e AS (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS value FROM events) SELECT event_id, coalesce(value, (SELECT avg(value) FROM e)) AS value FROM e")
def imputed(t):
    return sites.imputed(t.events.select("event_id", F.expr("CASE WHEN event_id % 7 <> 0 THEN value END").alias("value")), "value")


@query("SELECT min(c_custkey) AS c_custkey FROM customer GROUP BY lower(c_mktsegment)")
def deduplicated(t):
    return sites.deduplicated(t.customer, "c_mktsegment", "c_custkey").select("c_custkey")


@query("SELECT p_partkey FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_retailprice <= a.p_retailprice AND b.p_size >= a.p_size AND (b.p_retailprice < a.p_retailprice OR b.p_size > a.p_size))")
def pareto(t):
    return sites.pareto(t.part, "p_retailprice", "p_size").select("p_partkey")
