"""Every query of the engine over the driver's tables, with DuckDB SQL for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import equations as eq
from lodestone.functions import geometry as geo
from lodestone.operators import expression, network, raster, spatial, stats, table, temporal
from lodestone.scratch import dealt

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


class Tables:
    """The tables of a folder, read when asked for, and what is derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        # Instants, which can be counted in seconds; the files hold them without a zone.
        return rows.withColumn("ts", F.col("ts").cast("timestamp")) if name == "events" else rows

    def points(self) -> DataFrame:
        """The first two components of each embedding as a place, its label as a value."""
        e = self.embeddings
        return e.select(F.col("vec_id").alias("id"), F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"), F.col("label").cast("double").alias("v"))

    def facilities(self) -> DataFrame:
        return self.points().filter("id % 25 = 0")

    def demand(self) -> DataFrame:
        return self.points().filter("id % 25 <> 0")

    def zones(self) -> DataFrame:
        """A rectangle for each nation, on a grid."""
        n = self.nation
        k = F.col("n_nationkey")
        x, y = (k % 5) * 0.16 - 0.4, F.floor(k / 5) * 0.16 - 0.4
        return n.select(k.cast("long").alias("id"), x.alias("min_x"), y.alias("min_y"), (x + 0.12).alias("max_x"), (y + 0.12).alias("max_y"))

    def cells(self) -> DataFrame:
        """A 64 x 64 raster of mean quantities."""
        by = [(F.col("l_orderkey") % 64).alias("row"), (F.col("l_partkey") % 64).alias("col")]
        return self.lineitem.groupBy(*by).agg(F.avg("l_quantity").alias("value"))

    def grid(self, n: int = 12) -> DataFrame:
        """Edges of an n x n street grid, to the right and down."""
        s = self.spark.range(n * n).select(F.col("id").alias("a"))
        right = s.filter(F.col("a") % n < n - 1).select(F.col("a").alias("src"), (F.col("a") + 1).alias("dst"), (1 + (F.col("a") * 7) % 5).cast("double").alias("cost"))
        down = s.filter(F.col("a") < n * (n - 1)).select(F.col("a").alias("src"), (F.col("a") + n).alias("dst"), (1 + (F.col("a") * 3) % 4).cast("double").alias("cost"))
        return right.unionByName(down)

    def places(self) -> DataFrame:
        c = F.col("c_custkey")
        return self.customer.select(c.alias("id"), (((c * 37) % 3600) / 10.0 - 180).alias("lon"), (((c * 53) % 1700) / 10.0 - 85).alias("lat"))


POINTS = "p AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(label AS DOUBLE) AS v FROM embeddings), f AS (SELECT * FROM p WHERE id % 25 = 0), d AS (SELECT * FROM p WHERE id % 25 <> 0)"
ZONES = "z AS (SELECT CAST(n_nationkey AS BIGINT) AS id, (n_nationkey % 5) * 0.16::DOUBLE - 0.4::DOUBLE AS min_x, floor(n_nationkey / 5) * 0.16::DOUBLE - 0.4::DOUBLE AS min_y FROM nation), zone AS (SELECT id, min_x, min_y, min_x + 0.12::DOUBLE AS max_x, min_y + 0.12::DOUBLE AS max_y FROM z)"
DIST = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"
CELLS = "cells AS (SELECT l_orderkey % 64 AS row, l_partkey % 64 AS col, avg(l_quantity) AS value FROM lineitem GROUP BY 1, 2)"
GRID = "g AS (SELECT range AS a FROM range(144)), e AS (SELECT a AS src, a + 1 AS dst, CAST(1 + (a * 7) % 5 AS DOUBLE) AS cost FROM g WHERE a % 12 < 11 UNION ALL SELECT a, a + 12, CAST(1 + (a * 3) % 4 AS DOUBLE) FROM g WHERE a < 132)"
PLACES = "pl AS (SELECT c_custkey AS id, ((c_custkey * 37) % 3600) / 10.0::DOUBLE - 180 AS lon, ((c_custkey * 53) % 1700) / 10.0::DOUBLE - 85 AS lat FROM customer)"


def query(sql: str | None):
    """Registers a function of Tables under its name, with its SQL."""

    def add(f):
        name = f.__name__
        _QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            _SQL[name] = sql
        return f

    return add


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


# Joins on places.


@query(f"WITH {POINTS} SELECT a.id AS id, count(*) AS n, round(sum(b.v), 6) AS demand, round(avg({DIST}), 6) AS mean_distance FROM f a JOIN d b ON {DIST} <= 0.05 GROUP BY 1")
def proximity_rollup(t):
    pairs = spatial.within_distance_pairs(t.facilities(), t.demand(), 0.05, "d")
    return pairs.groupBy("id").agg(F.count("*").alias("n"), r6(F.sum("v_d")).alias("demand"), r6(F.avg("distance")).alias("mean_distance"))


@query(f"WITH {POINTS} SELECT a.id, b.id AS id_right, round({DIST}, 6) AS distance FROM f a JOIN d b ON {DIST} <= 0.05")
def proximity_join(t):
    return spatial.proximity_join(t.facilities(), t.demand(), 0.05).select("id", "id_right", r6("distance").alias("distance"))


@query(f"WITH {POINTS} SELECT a.id, b.id AS id_right, round({DIST}, 6) AS distance FROM f a LEFT JOIN d b ON {DIST} <= 0.02")
def proximity_join_left(t):
    return spatial.proximity_join(t.facilities(), t.demand(), 0.02, "left").select("id", "id_right", r6("distance").alias("distance"))


_KNN = f"SELECT a.id, b.id AS id_right, round({DIST}, 6) AS distance, row_number() OVER (PARTITION BY a.id ORDER BY {DIST}, CAST(b.id AS VARCHAR)) AS rank"


@query(f"WITH {POINTS}, r AS ({_KNN} FROM f a, d b) SELECT id, id_right, distance, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 2")
def nearest_join_k2(t):
    return spatial.nearest_join(t.facilities(), t.demand(), 2).select("id", "id_right", r6("distance").alias("distance"), "rank")


@query(f"WITH {POINTS}, r AS ({_KNN} FROM f a JOIN d b ON {DIST} <= 0.03) SELECT f.id, r.id_right, r.distance, CAST(r.rank AS INTEGER) AS rank FROM f LEFT JOIN (SELECT * FROM r WHERE rank <= 2) r ON f.id = r.id")
def nearest_join_maxdist_left(t):
    return spatial.nearest_join(t.facilities(), t.demand(), 2, "left", 0.03).select("id", "id_right", r6("distance").alias("distance"), "rank")


@query(f"WITH {POINTS}, r AS ({_KNN} FROM p a JOIN p b ON a.id <> b.id) SELECT id, id_right, distance FROM r WHERE rank = 1")
def nearest_neighbors(t):
    return spatial.nearest_join(t.points(), t.points(), 1, exclude_self=True).select("id", "id_right", r6("distance").alias("distance"))


@query(f"WITH {POINTS}, r AS ({_KNN} FROM d a, f b) SELECT id, id_right AS id_provider, distance FROM r WHERE rank = 1")
def assign_nearest(t):
    return spatial.assign_nearest(t.facilities(), t.demand()).select("id", "id_provider", r6("distance").alias("distance"))


@query(f"WITH {POINTS}, r AS ({_KNN.replace('b.id AS id_right', 'b.id AS id_right, a.v')} FROM d a, f b) SELECT f.id, count(r.id) AS n, round(coalesce(sum(r.v), 0), 6) AS demand FROM f LEFT JOIN (SELECT * FROM r WHERE rank = 1) r ON r.id_right = f.id GROUP BY 1")
def summarize_assignments(t):
    got = spatial.assign_nearest(t.facilities(), t.demand()).groupBy("id_provider").agg(F.count("*").alias("n"), F.sum("v").alias("demand"))
    out = t.facilities().select("id").join(got, F.col("id") == F.col("id_provider"), "left")
    return out.select("id", F.coalesce("n", F.lit(0)).alias("n"), r6(F.coalesce("demand", F.lit(0.0))).alias("demand"))


@query(f"WITH {POINTS}, q AS (SELECT a.id AS fid, b.id AS did FROM f a JOIN d b ON {DIST} <= 0.08), c AS (SELECT did, count(*) AS n FROM q GROUP BY 1) SELECT f.id, count(*) FILTER (WHERE c.n = 1) AS exclusive, count(*) FILTER (WHERE c.n > 1) AS contested, count(c.did) AS total FROM f LEFT JOIN q ON q.fid = f.id LEFT JOIN c ON c.did = q.did GROUP BY 1")
def catchment_competition(t):
    return spatial.catchment_competition(t.facilities(), t.demand(), 0.08)


@query(f"WITH {POINTS} SELECT a.id, round({DIST}, 6) AS distance FROM p a, (SELECT 0.1::DOUBLE AS x, 0.05::DOUBLE AS y) b WHERE {DIST} <= 0.1")
def query_radius(t):
    return spatial.radius_filter(t.points(), 0.1, 0.05, 0.1).select("id", r6("distance").alias("distance"))


@query(f"WITH {POINTS} SELECT id, v FROM p WHERE x BETWEEN -0.1 AND 0.1 AND y BETWEEN -0.05 AND 0.2")
def query_bounds(t):
    return spatial.box_filter(t.points(), -0.1, -0.05, 0.1, 0.2).select("id", "v")


@query(f"WITH {POINTS}, {ZONES} SELECT p.id, zone.id AS id_zone FROM p JOIN zone ON p.x BETWEEN min_x AND max_x AND p.y BETWEEN min_y AND max_y")
def spatial_join_rect(t):
    return spatial.box_join(t.points(), t.zones(), 0.1).select("id", "id_zone")


@query(f"WITH {POINTS}, {ZONES} SELECT zone.id, count(p.id) AS n, round(coalesce(sum(p.v), 0), 6) AS total FROM zone LEFT JOIN p ON p.x BETWEEN min_x AND max_x AND p.y BETWEEN min_y AND max_y GROUP BY 1")
def coverage_summary(t):
    got = spatial.box_join(t.points(), t.zones(), 0.1).groupBy("id_zone").agg(F.count("*").alias("n"), F.sum("v").alias("total"))
    out = t.zones().select("id").join(got, F.col("id") == F.col("id_zone"), "left")
    return out.select("id", F.coalesce("n", F.lit(0)).alias("n"), r6(F.coalesce("total", F.lit(0.0))).alias("total"))


@query(f"WITH {POINTS}, {ZONES} SELECT p.id, zone.id AS id_zone FROM p JOIN zone ON p.x BETWEEN min_x AND max_x AND p.y BETWEEN min_y AND max_y")
def spatial_join_polygon(t):
    """The same zones as polygons, by the exact test."""
    z = t.zones().withColumn("g", geo.rectangle(F.col("min_x"), F.col("min_y"), F.col("max_x"), F.col("max_y")))
    return spatial.box_join(t.points(), z, 0.1).filter(geo.contains_point(F.col("g_zone"), F.col("x"), F.col("y"))).select("id", "id_zone")


@query(f"WITH {ZONES} SELECT id, round((max_x - min_x) * (max_y - min_y), 6) AS area, round(2 * (max_x - min_x) + 2 * (max_y - min_y), 6) AS length, 5 AS vertices FROM zone")
def geometry_metrics(t):
    z = t.zones().withColumn("g", geo.rectangle(F.col("min_x"), F.col("min_y"), F.col("max_x"), F.col("max_y")))
    return z.select("id", r6(geo.area(F.col("g"))).alias("area"), r6(geo.length(F.col("g"))).alias("length"), F.size(geo.vertices(F.col("g"))).alias("vertices"))


@query("WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey % 50 AS route, l_suppkey % 20 * 1.0 AS lo, l_suppkey % 20 + l_quantity / 10 AS hi FROM lineitem) SELECT count(*) AS pairs, round(sum(least(x.hi, y.hi) - greatest(x.lo, y.lo)), 4) AS overlap FROM a x JOIN a y ON x.route = y.route AND x.lo < y.hi AND y.lo < x.hi")
def overlay_route_events(t):
    """Equal intervals of a route are joined once, with how many rows each stands for."""
    a = t.lineitem.select((F.col("l_partkey") % 50).alias("route"), (F.col("l_suppkey") % 20).cast("double").alias("lo"), (F.col("l_suppkey") % 20 + F.col("l_quantity") / 10).alias("hi"))
    a = a.groupBy("route", "lo", "hi").agg(F.count("*").alias("n"))
    pairs = spatial.interval_join(a, a, "route", "lo", "hi", 5.0).withColumn("n", F.col("n") * F.col("n_right"))
    shared = F.least("hi", "hi_right") - F.greatest("lo", "lo_right")
    return pairs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"), F.round(F.sum(F.col("n") * shared), 4).alias("overlap"))


# Equations.

_H = "pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)"


@query(f"WITH {PLACES}, h AS (SELECT a.id, b.id AS id_b, {_H} AS h FROM pl a JOIN pl b ON b.id = a.id + 1) SELECT id, id_b, round(2 * 6371.0088 * atan2(sqrt(h), sqrt(greatest(0, 1 - h))), 4) AS km FROM h")
def haversine_pairs(t):
    a, b = t.places(), t.places().select(F.col("id").alias("id_b"), F.col("lon").alias("lon_b"), F.col("lat").alias("lat_b"))
    return a.join(b, F.col("id_b") == F.col("id") + 1).select("id", "id_b", F.round(eq.haversine(F.col("lon"), F.col("lat"), F.col("lon_b"), F.col("lat_b")), 4).alias("km"))


@query("SELECT o_orderkey, round(1 / pow(1 + o_totalprice / 100000, 2), 9) AS power, round(exp(-o_totalprice / 100000), 9) AS exponential, round(exp(-pow(o_totalprice / 100000, 2) / 2), 9) AS gaussian FROM orders")
def decays(t):
    d = F.col("o_totalprice") / 100000
    return t.orders.select("o_orderkey", F.round(eq.power_decay(d), 9).alias("power"), F.round(eq.exponential_decay(d), 9).alias("exponential"), F.round(eq.gaussian_decay(d), 9).alias("gaussian"))


@query("SELECT l_orderkey, l_linenumber, round(l_quantity * l_extendedprice / pow(1 + l_tax, 2), 4) AS gravity, round(1 / (1 + exp(-(l_discount * 10 - 0.5))), 9) AS probability, round(l_quantity * ln(1 + l_extendedprice) / pow(1 + l_tax, 2), 6) AS corridor FROM lineitem")
def gravity_and_probability(t):
    c = F.col
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(eq.gravity(c("l_quantity"), c("l_extendedprice"), 1 + c("l_tax")), 4).alias("gravity"), F.round(eq.logistic(c("l_discount") * 10 - 0.5), 9).alias("probability"), r6(eq.corridor_strength(c("l_quantity"), c("l_extendedprice"), c("l_tax"))).alias("corridor"))


@query(f"WITH {POINTS} SELECT a.id AS origin, b.id AS destination, round(a.v * b.v / pow(1 + {DIST}, 2), 6) AS interaction, round(((degrees(atan2(b.x - a.x, b.y - a.y)) % 360) + 360) % 360, 4) AS bearing FROM p a JOIN p b ON a.id <> b.id")
def interaction_table(t):
    d = eq.euclidean(F.col("x"), F.col("y"), F.col("x_b"), F.col("y_b"))
    return spatial.all_pairs(t.points(), t.points(), "b").filter(F.col("id") != F.col("id_b")).select(F.col("id").alias("origin"), F.col("id_b").alias("destination"), r6(eq.interaction(F.col("v"), F.col("v_b"), d)).alias("interaction"), F.round(eq.bearing(F.col("x"), F.col("y"), F.col("x_b"), F.col("y_b")), 4).alias("bearing"))


@query(f"WITH {POINTS} SELECT a.id, round(sum(b.v / pow(1 + {DIST} / 0.1, 2)), 6) AS pressure FROM p a JOIN p b ON a.id <> b.id GROUP BY 1")
def neighborhood_pressure(t):
    return stats.neighborhood_pressure(t.points(), 0.1).select("id", r6("pressure").alias("pressure"))


@query(f"WITH {POINTS} SELECT a.id, round(a.v / pow(1 + {DIST}, 2), 6) AS influence FROM p a, (SELECT * FROM p WHERE id = 0) b")
def anchor_influence(t):
    anchor = F.broadcast(t.points().filter("id = 0").select(F.col("x").alias("ax"), F.col("y").alias("ay")))
    return t.points().crossJoin(anchor).select("id", r6(eq.influence(F.col("v"), eq.euclidean(F.col("x"), F.col("y"), F.col("ax"), F.col("ay")))).alias("influence"))


@query("SELECT p_partkey, least(p_size, p_retailprice / 50) / greatest(p_size, p_retailprice / 50) / (1 + p_size / 10.0::DOUBLE) AS similarity, pow(p_size / (p_retailprice / 50), 2) AS stress, least(1, greatest(0, (p_retailprice - p_size * 20) / p_retailprice)) AS deficit, 0.01::DOUBLE * exp(p_size * 0.03::DOUBLE) AS failure FROM part")
def utility_equations(t):
    c = F.col
    size, price = c("p_size").cast("double"), c("p_retailprice")
    return t.part.select("p_partkey", eq.area_similarity(size, price / 50, size / 10).alias("similarity"), eq.capacity_stress(size, price / 50).alias("stress"), eq.service_deficit(price, size * 20).alias("deficit"), eq.failure_rate(F.lit(0.01), size).alias("failure"))


@query("SELECT p_partkey, round(10.67 * p_size * pow(p_retailprice / 130, 1.852) / pow(2, 4.87), 4) AS headloss, round(p_size / pow(1 + 1.0, 2) + p_retailprice / pow(1 + 2.0, 2), 6) AS accessibility FROM part")
def headloss_and_accessibility(t):
    size, price = F.col("p_size").cast("double"), F.col("p_retailprice")
    return t.part.select("p_partkey", F.round(eq.headloss(size, price, F.lit(2.0)), 4).alias("headloss"), r6(eq.accessibility(F.array(size, price), F.array(F.lit(1.0), F.lit(2.0)))).alias("accessibility"))


# Tables.


@query("SELECT o.o_orderkey, o.o_custkey, c.c_name, c.c_mktsegment FROM orders o JOIN customer c ON o.o_custkey IS NOT DISTINCT FROM c.c_custkey")
def merge_inner(t):
    c = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    return table.merge(t.orders.select("o_orderkey", "o_custkey"), c, ["o_custkey"])


@query("SELECT c.c_custkey, o.o_orderkey, CASE WHEN o.o_orderkey IS NULL THEN 'left_only' ELSE 'both' END AS _merge FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey")
def merge_left_indicator(t):
    o = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return table.merge(t.customer.select("c_custkey"), o, ["c_custkey"], "left", indicator=True)


@query("WITH a AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS k FROM customer), b AS (SELECT n_nationkey, CASE WHEN n_nationkey % 6 = 0 THEN NULL ELSE 'BUILDING' END AS k FROM nation) SELECT c_custkey, n_nationkey, a.k FROM a JOIN b ON a.k IS NOT DISTINCT FROM b.k")
def join_nullsafe(t):
    a = t.customer.select("c_custkey", F.expr("CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END").alias("k"))
    b = t.nation.select("n_nationkey", F.expr("CASE WHEN n_nationkey % 6 = 0 THEN NULL ELSE 'BUILDING' END").alias("k"))
    return table.merge(a, b, ["k"])


@query("SELECT o.o_orderkey, count(l.l_orderkey) AS lines FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY 1")
def one_to_many_counts(t):
    return table.one_to_many(t.orders.select("o_orderkey"), t.lineitem.select("l_orderkey", "l_linenumber"), "o_orderkey", "l_orderkey", "lines").select("o_orderkey", F.size("lines").cast("long").alias("lines"))


@query("SELECT s.s_name, p.p_brand, count(*) AS n FROM supplier s JOIN lineitem l ON s.s_suppkey = l.l_suppkey JOIN part p ON p.p_partkey = l.l_partkey GROUP BY 1, 2")
def many_to_many_join(t):
    j = t.supplier.join(t.lineitem, F.col("s_suppkey") == F.col("l_suppkey")).join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    return j.groupBy("s_name", "p_brand").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, round(o_totalprice * 1.1, 6) FROM orders WHERE o_orderkey % 2 = 1")
def upsert(t):
    o = t.orders.select("o_orderkey", "o_totalprice")
    return table.upsert(o, o.filter("o_orderkey % 2 = 1").withColumn("o_totalprice", r6(F.col("o_totalprice") * 1.1)), "o_orderkey")


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS l_quantity_sum, round(avg(l_extendedprice), 4) AS l_extendedprice_mean, median(l_quantity) AS l_quantity_median, min(l_discount) AS l_discount_min, max(l_tax) AS l_tax_max, count(l_orderkey) AS l_orderkey_count, count(DISTINCT l_partkey) AS l_partkey_unique_count FROM lineitem GROUP BY 1, 2")
def groupby_agg_all_ops(t):
    out = table.group_agg(t.lineitem, ["l_returnflag", "l_linestatus"], {"l_quantity": ["sum", "median"], "l_extendedprice": ["mean"], "l_discount": ["min"], "l_tax": ["max"], "l_orderkey": ["count"], "l_partkey": ["unique_count"]})
    return out.withColumn("l_quantity_sum", F.round("l_quantity_sum", 2)).withColumn("l_extendedprice_mean", F.round("l_extendedprice_mean", 4))


@query("SELECT o_orderpriority, count(*) AS count FROM orders GROUP BY 1")
def value_counts(t):
    return table.value_counts(t.orders, "o_orderpriority")


@query("SELECT 'l_quantity' AS \"column\", count(l_quantity) AS count, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS std, min(l_quantity) AS min, max(l_quantity) AS max FROM lineitem UNION ALL SELECT 'l_tax', count(l_tax), round(avg(l_tax), 6), round(stddev_pop(l_tax), 6), min(l_tax), max(l_tax) FROM lineitem")
def describe(t):
    return table.describe(t.lineitem, ["l_quantity", "l_tax"]).withColumn("mean", r6("mean")).withColumn("std", r6("std"))


@query("SELECT l_returnflag, round(sum(l_quantity) FILTER (WHERE l_linestatus = 'F'), 2) AS \"F\", round(sum(l_quantity) FILTER (WHERE l_linestatus = 'O'), 2) AS \"O\" FROM lineitem GROUP BY 1")
def pivot_sum(t):
    return table.pivot(t.lineitem, "l_returnflag", "l_linestatus", ["F", "O"], "l_quantity").select("l_returnflag", F.round("F", 2).alias("F"), F.round("O", 2).alias("O"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
def crosstab_count(t):
    return t.orders.groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT l_suppkey, l_orderkey, l_linenumber, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) = 1")
def drop_duplicates_first(t):
    l = t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity", "l_partkey")  # noqa: E741
    return table.drop_duplicates(l, ["l_suppkey"], [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")]).drop("l_partkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def nlargest(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 25")
def nsmallest(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy("o_totalprice", "o_orderkey").limit(25)


_EVENTS = "PARTITION BY user_id ORDER BY event_id"


@query(f"SELECT event_id, round(sum(value) OVER ({_EVENTS}), 6) AS cumsum, max(value) OVER ({_EVENTS}) AS cummax, min(value) OVER ({_EVENTS}) AS cummin, round(avg(value) OVER ({_EVENTS}), 6) AS expanding_mean FROM events")
def running_functions(t):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return t.events.select("event_id", r6(table.running("value", w, "sum")).alias("cumsum"), table.running("value", w, "max").alias("cummax"), table.running("value", w, "min").alias("cummin"), r6(table.running("value", w, "mean")).alias("expanding_mean"))


@query(f"SELECT event_id, round(value - lag(value) OVER ({_EVENTS}), 6) AS diff, CASE WHEN lag(value) OVER ({_EVENTS}) <> 0 THEN round((value - lag(value) OVER ({_EVENTS})) / abs(lag(value) OVER ({_EVENTS})), 6) END AS pct_change FROM events")
def diff_and_pct_change(t):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return t.events.select("event_id", r6(table.difference("value", w)).alias("diff"), r6(table.difference("value", w, relative=True)).alias("pct_change"))


_R5 = f"OVER ({_EVENTS} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"


@query(f"SELECT event_id, CASE WHEN row_number() OVER ({_EVENTS}) >= 5 THEN round(avg(value) {_R5}, 6) END AS rolling_mean, round(max(value) {_R5}, 6) AS rolling_max FROM events")
def rolling_functions(t):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return t.events.select("event_id", r6(table.rolling("value", w, 5)).alias("rolling_mean"), r6(table.rolling("value", w, 5, "max", partial=True)).alias("rolling_max"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CAST(rank() OVER w AS DOUBLE) + (count(*) OVER (PARTITION BY l_orderkey, l_discount) - 1) / 2.0 AS average, CAST(rank() OVER w AS INTEGER) AS min, CAST(rank() OVER w + count(*) OVER (PARTITION BY l_orderkey, l_discount) - 1 AS BIGINT) AS max, CAST(dense_rank() OVER w AS INTEGER) AS dense FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_discount)")
def rank_methods(t):
    r = lambda m: table.rank("l_discount", ["l_orderkey"], m)
    rows = dealt(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_discount"), "l_orderkey")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", r("average").cast("double").alias("average"), r("min").alias("min"), r("max").cast("long").alias("max"), r("true_dense").alias("dense"))


@query("SELECT s_suppkey, 's_acctbal' AS variable, s_acctbal AS value FROM supplier UNION ALL SELECT s_suppkey, 's_nationkey', CAST(s_nationkey AS DOUBLE) FROM supplier")
def melt(t):
    return t.supplier.select("s_suppkey", "s_acctbal", F.col("s_nationkey").cast("double").alias("s_nationkey")).unpivot(["s_suppkey"], ["s_acctbal", "s_nationkey"], "variable", "value")


@query("SELECT vec_id, CAST(i - 1 AS INTEGER) AS part, CAST(embedding[i] AS DOUBLE) AS value FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)")
def explode_parts(t):
    return t.embeddings.select("vec_id", F.posexplode("embedding").alias("part", "value")).withColumn("value", F.col("value").cast("double"))


@query("SELECT c_custkey AS id, 'c' AS kind, c_acctbal AS bal, NULL AS n FROM customer UNION ALL SELECT s_suppkey, 's', s_acctbal, s_nationkey FROM supplier")
def concat_union(t):
    a = t.customer.select(F.col("c_custkey").alias("id"), F.lit("c").alias("kind"), F.col("c_acctbal").alias("bal"))
    b = t.supplier.select(F.col("s_suppkey").alias("id"), F.lit("s").alias("kind"), F.col("s_acctbal").alias("bal"), F.col("s_nationkey").alias("n"))
    return a.unionByName(b, allowMissingColumns=True)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'removed' WHEN o_orderkey % 7 = 0 THEN 'added' WHEN o_orderkey % 3 = 0 THEN 'modified' ELSE 'identical' END AS status FROM orders WHERE NOT (o_orderkey % 5 = 0 AND o_orderkey % 7 = 0)")
def table_compare(t):
    o = t.orders.select("o_orderkey", "o_totalprice")
    new = o.filter("o_orderkey % 5 <> 0").withColumn("o_totalprice", F.when(F.expr("o_orderkey % 3 = 0"), F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return table.compare(o.filter("o_orderkey % 7 <> 0"), new, "o_orderkey", ["o_totalprice"])


# Expressions and accessors.


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 30 AND (l_discount < 0.03 OR l_returnflag = 'R')")
def query_expr(t):
    l = t.lineitem  # noqa: E741
    return l.filter(expression.compile_expression("l_quantity >= 30 and (l_discount < 0.03 or l_returnflag == 'R')", l.columns)).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 4) AS charge FROM lineitem")
def eval_expr(t):
    l = t.lineitem  # noqa: E741
    return l.select("l_orderkey", "l_linenumber", "l_partkey", expression.compile_expression("round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 4)", l.columns).alias("charge"))


@query("SELECT p_partkey, p_name FROM part WHERE lower(p_brand) LIKE '%3%' AND p_size BETWEEN 10 AND 20 AND p_type IN (SELECT min(p_type) FROM part UNION SELECT max(p_type) FROM part)")
def where_predicates(t):
    p = t.part
    w = lambda s: expression.compile_where(s, p.columns)
    ends = p.agg(F.min("p_type"), F.max("p_type")).head()
    return p.filter(w("p_brand LIKE '%3%'") & w("p_size BETWEEN 10 AND 20") & w(f"p_type IN ({ends[0]!r}, {ends[1]!r})")).select("p_partkey", "p_name")


@query("SELECT c_custkey, upper(c_name) AS up, lower(c_mktsegment) AS low, length(c_name) AS n, contains(c_name, '1') AS has, replace(c_name, '#', '-') AS rep FROM customer")
def string_accessors(t):
    return t.customer.select("c_custkey", F.upper("c_name").alias("up"), F.lower("c_mktsegment").alias("low"), F.length("c_name").cast("long").alias("n"), F.contains("c_name", F.lit("1")).alias("has"), F.replace("c_name", F.lit("#"), F.lit("-")).alias("rep"))


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, CAST(day(o_orderdate) AS INTEGER) AS day, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS weekday FROM orders")
def date_accessors(t):
    return t.orders.select("o_orderkey", F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"), F.dayofmonth("o_orderdate").alias("day"), F.weekday("o_orderdate").alias("weekday"))


# Time.


@query("SELECT epoch(time_bucket(INTERVAL '1 hour', ts))::BIGINT AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def temporal_window_tumbling(t):
    out = temporal.tumbling(t.events, "ts", "1 hour", ["event_type"], {"n": F.count("*"), "total": r6(F.sum("value"))})
    return out.select(F.unix_timestamp("start").alias("start"), "event_type", "n", "total")


@query("SELECT epoch(time_bucket(INTERVAL '1 hour', ts))::BIGINT - i * 3600 AS start, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS i) GROUP BY 1")
def temporal_window_sliding(t):
    return temporal.tumbling(t.events, "ts", "2 hours", [], {"n": F.count("*")}, "1 hour").select(F.unix_timestamp("start").alias("start"), "n")


@query("SELECT epoch(date_trunc('day', ts))::BIGINT AS day, round(avg(value), 6) AS mean, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def resample_daily(t):
    return t.events.groupBy(F.unix_timestamp(F.date_trunc("day", "ts")).alias("day")).agg(r6(F.avg("value")).alias("mean"), F.countDistinct("user_id").alias("users"))


@query("SELECT user_id, round(regr_slope(value, event_id), 6) AS slope, round(regr_intercept(value, event_id), 4) AS intercept, round(regr_r2(value, event_id), 6) AS r2 FROM events GROUP BY 1")
def time_series_trend(t):
    x, y = F.col("event_id").cast("double"), F.col("value")
    return t.events.groupBy("user_id").agg(r6(F.regr_slope(y, x)).alias("slope"), F.round(F.regr_intercept(y, x), 4).alias("intercept"), r6(F.regr_r2(y, x)).alias("r2"))


@query("WITH a AS (SELECT event_id, ts, user_id FROM events WHERE event_id % 2 = 0), b AS (SELECT event_id, ts, user_id FROM events WHERE event_id % 2 = 1), j AS (SELECT a.event_id, b.event_id AS event_id_right, abs(epoch(a.ts) - epoch(b.ts)) AS gap FROM a JOIN b USING (user_id) WHERE abs(epoch(a.ts) - epoch(b.ts)) <= 21600) SELECT event_id, event_id_right FROM j QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY gap, event_id_right) = 1")
def temporal_join_nearest(t):
    e = t.events.select("event_id", "ts", "user_id")
    return temporal.asof_nearest(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), "ts", "user_id", 21600, "event_id").select("event_id", "event_id_right")


@query("SELECT CAST(floor(user_id / 4) AS BIGINT) AS xb, CAST(floor(value / 10) AS BIGINT) AS yb, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS tb, count(*) AS n FROM events GROUP BY 1, 2, 3")
def space_time_cube(t):
    b = lambda c, s, n: F.floor(c / s).cast("long").alias(n)
    return t.events.groupBy(b(F.col("user_id"), 4, "xb"), b(F.col("value"), 10, "yb"), b(F.col("ts").cast("double"), 86400, "tb")).agg(F.count("*").alias("n"))


@query("WITH s AS (SELECT user_id, event_id, value, value - lag(value) OVER w AS d, epoch(ts) - lag(epoch(ts)) OVER w AS dt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, count(*) AS n, round(sum(abs(d)), 6) AS path, round(sum(dt), 3) AS seconds, min(value) AS lo, max(value) AS hi FROM s GROUP BY 1")
def trajectory_analysis(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = t.events.select("user_id", "value", (F.col("value") - F.lag("value").over(w)).alias("d"), (F.col("ts").cast("double") - F.lag(F.col("ts").cast("double")).over(w)).alias("dt"))
    return e.groupBy("user_id").agg(F.count("*").alias("n"), r6(F.sum(F.abs("d"))).alias("path"), F.round(F.sum("dt"), 3).alias("seconds"), F.min("value").alias("lo"), F.max("value").alias("hi"))


@query("WITH s AS (SELECT user_id, ts, CASE WHEN epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 14400 THEN 0 ELSE 1 END AS fresh FROM events), g AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s) SELECT user_id, floor(epoch(min(ts)))::BIGINT AS start, count(*) AS n FROM g GROUP BY user_id, k")
def sessions(t):
    return temporal.sessions(t.events, "ts", "user_id", "4 hours").select("user_id", F.unix_timestamp("start").alias("start"), "n")


# Statistics.

_EDGES = f"w AS (SELECT a.id AS i, b.id AS j, a.v AS vi, b.v AS vj FROM p a JOIN p b ON a.id <> b.id AND {DIST} <= 0.05), m AS (SELECT count(*) AS n, avg(v) AS mean, sum((v - (SELECT avg(v) FROM p)) * (v - (SELECT avg(v) FROM p))) AS ss FROM p)"


@query(f"WITH {POINTS}, {_EDGES} SELECT round(n / count(*) * sum((vi - mean) * (vj - mean)) / ss, 6) AS moran_i, round(-1.0 / (n - 1), 9) AS expected FROM w, m GROUP BY n, mean, ss")
def morans_i(t):
    p = t.points()
    return stats.morans_i(p, stats.weights(p, 0.05)).select(r6("moran_i").alias("moran_i"), F.round("expected", 9).alias("expected"))


@query(f"WITH {POINTS}, {_EDGES} SELECT round((n - 1) * sum((vi - vj) * (vi - vj)) / (2 * count(*) * ss), 6) AS geary_c FROM w, m GROUP BY n, ss")
def gearys_c(t):
    p = t.points()
    return stats.gearys_c(p, stats.weights(p, 0.05)).select(r6("geary_c").alias("geary_c"))


@query(f"WITH {POINTS}, {_EDGES} SELECT p.id, round(coalesce(avg(vj), 0), 6) AS lag FROM p LEFT JOIN w ON w.i = p.id GROUP BY 1")
def spatial_lag(t):
    p = t.points()
    return stats.spatial_lag(p, stats.weights(p, 0.05)).select("id", r6("lag").alias("lag"))


@query(f"WITH {POINTS}, q AS (SELECT {DIST} AS dist, a.v AS va, b.v AS vb FROM p a JOIN p b ON a.id < b.id AND {DIST} <= 0.1) SELECT CAST(floor(dist / 0.02) AS BIGINT) AS bin, count(*) AS pairs, round(avg(dist), 6) AS mean_distance, round(avg((va - vb) * (va - vb)) / 2, 6) AS semivariance FROM q GROUP BY 1")
def semivariogram(t):
    return stats.semivariogram(t.points(), 0.02, 0.1).select("bin", "pairs", r6("mean_distance").alias("mean_distance"), r6("semivariance").alias("semivariance"))


@query(f"WITH {POINTS} SELECT round(sum(x * v) / sum(v), 6) AS x, round(sum(y * v) / sum(v), 6) AS y FROM p")
def mean_center(t):
    return stats.mean_center(t.points(), F.col("v")).select(r6("x").alias("x"), r6("y").alias("y"))


@query(f"WITH {POINTS} SELECT round(sqrt(var_pop(x) + var_pop(y)), 6) AS standard_distance FROM p")
def standard_distance(t):
    return stats.standard_distance(t.points()).select(r6("standard_distance").alias("standard_distance"))


@query(f"WITH {POINTS} SELECT a.id, round(sum(b.v / pow({DIST}, 2)) / sum(1 / pow({DIST}, 2)), 6) AS value FROM f a LEFT JOIN d b ON {DIST} <= 0.1 GROUP BY 1")
def idw(t):
    return stats.idw(t.demand(), t.facilities(), 0.1).select("id", r6("value").alias("value"))


@query(f"WITH {POINTS}, n AS (SELECT count(*) AS n FROM p), k AS (SELECT unnest([0.02, 0.05, 0.08])::DOUBLE AS d) SELECT k.d, round(0.64 * count(*) / (n * n), 9) AS k FROM p a JOIN p b ON a.id <> b.id JOIN k ON {DIST} <= k.d, n GROUP BY k.d, n")
def ripley_k(t):
    return stats.ripley_k(t.points(), [0.02, 0.05, 0.08], 0.64).select("d", F.round("k", 9).alias("k"))


@query(f"WITH {POINTS}, q AS (SELECT a.id AS s, b.id AS dm, a.v + 1 AS cap, b.v + 1 AS pop FROM f a JOIN d b ON {DIST} <= 0.08), r AS (SELECT s, max(cap) / sum(pop) AS ratio FROM q GROUP BY 1) SELECT d.id, round(coalesce(sum(r.ratio), 0), 6) AS score FROM d LEFT JOIN q ON q.dm = d.id LEFT JOIN r ON r.s = q.s GROUP BY 1")
def two_step_fca(t):
    s = t.facilities().select("id", "x", "y", (F.col("v") + 1).alias("capacity"))
    d = t.demand().select("id", "x", "y", (F.col("v") + 1).alias("population"))
    return stats.two_step_catchment(s, d, 0.08).select("id", r6("score").alias("score"))


@query(f"WITH {POINTS}, q AS (SELECT a.id, b.id AS id_s, (b.v + 1) / pow(greatest({DIST}, 1e-9), 2) AS pull FROM d a, f b) SELECT id, id_s, round(pull / sum(pull) OVER (PARTITION BY id), 6) AS probability FROM q")
def huff_model(t):
    stores = t.facilities().withColumn("size", F.col("v") + 1)
    return stats.huff(stores, t.demand()).select("id", "id_s", r6("probability").alias("probability"))


@query("WITH m AS (SELECT min(s_acctbal) AS lo, max(s_acctbal) AS hi FROM supplier) SELECT s_suppkey, CAST(least(floor((s_acctbal - lo) / (hi - lo) * 5), 4) AS BIGINT) AS class FROM supplier, m")
def equal_interval(t):
    return stats.equal_interval(t.supplier.select("s_suppkey", "s_acctbal"), "s_acctbal", 5).select("s_suppkey", "class")


# Networks.


@query(f"WITH RECURSIVE {GRID}, s(node, cost) AS (SELECT 0::BIGINT, 0.0::DOUBLE UNION SELECT e.dst, s.cost + e.cost FROM s JOIN e ON s.node = e.src) SELECT 0::BIGINT AS origin, node, min(cost) AS cost FROM s GROUP BY 2")
def od_cost_matrix(t):
    return network.shortest_costs(t.grid(), t.spark.range(1).select(F.col("id").alias("node")))


@query(f"WITH RECURSIVE {GRID}, s(node, cost) AS (SELECT 0::BIGINT, 0.0::DOUBLE UNION SELECT e.dst, s.cost + e.cost FROM s JOIN e ON s.node = e.src WHERE s.cost + e.cost <= 10) SELECT node, min(cost) AS cost FROM s GROUP BY 1")
def service_area(t):
    return network.shortest_costs(t.grid(), t.spark.range(1).select(F.col("id").alias("node")), 10.0).select("node", "cost")


@query(f"WITH {GRID} SELECT node, count(*) AS degree, sum(cost) AS total_cost FROM (SELECT src AS node, cost FROM e UNION ALL SELECT dst, cost FROM e) GROUP BY 1")
def node_degrees(t):
    return network.degrees(t.grid())


@query("WITH o AS (SELECT user_id + 1.0 AS impacted, abs(value) / 10 AS hours FROM events) SELECT round(sum(impacted) / 1000, 6) AS saifi, round(sum(impacted * hours) / 1000, 4) AS saidi, round(sum(impacted * hours) / sum(impacted), 6) AS caidi FROM o")
def reliability_indices(t):
    o = t.events.select((F.col("user_id") + 1.0).alias("impacted"), (F.abs("value") / 10).alias("hours"))
    return network.reliability(o, 1000.0).select(r6("saifi").alias("saifi"), F.round("saidi", 4).alias("saidi"), r6("caidi").alias("caidi"))


# Rasters.


@query(f"WITH {CELLS} SELECT a.row, a.col, round((a.value - b.value) / (a.value + b.value), 6) AS value FROM cells a JOIN (SELECT col AS row, row AS col, value FROM cells) b ON a.row = b.row AND a.col = b.col")
def normalized_difference(t):
    turned = t.cells().select(F.col("col").alias("row"), F.col("row").alias("col"), "value")
    return raster.algebra(t.cells(), turned, raster.normalized_difference).withColumn("value", r6("value"))


@query(f"WITH {CELLS} SELECT a.row, a.col, round(avg(b.value), 6) AS value FROM cells a JOIN cells b ON b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 GROUP BY 1, 2")
def focal_mean(t):
    return raster.focal(t.cells(), 1).withColumn("value", r6("value"))


@query(f"WITH {CELLS} SELECT row // 8 AS row, col // 8 AS col, round(avg(value), 6) AS value FROM cells GROUP BY 1, 2")
def block_mean(t):
    return raster.block(t.cells(), 8).withColumn("value", r6("value"))


@query(f"WITH {CELLS} SELECT (row + col) % 5 AS zone, count(*) AS count, round(sum(value), 4) AS sum, round(avg(value), 6) AS mean, round(min(value), 6) AS min, round(max(value), 6) AS max FROM cells GROUP BY 1")
def zonal_summary(t):
    zones = t.cells().select("row", "col", ((F.col("row") + F.col("col")) % 5).alias("zone"))
    return raster.zonal(t.cells(), zones).select("zone", "count", F.round("sum", 4).alias("sum"), r6("mean").alias("mean"), r6("min").alias("min"), r6("max").alias("max"))


@query(f"WITH {CELLS} SELECT row, col, CAST((value >= 20)::INT + (value >= 25)::INT + (value >= 30)::INT AS BIGINT) AS class FROM cells")
def reclassify(t):
    return t.cells().select("row", "col", raster.reclassify(F.col("value"), [20.0, 25.0, 30.0]).alias("class"))


@query("WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, list_dot_product(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])) AS score FROM embeddings, q WHERE vec_id <> 0) SELECT vec_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, vec_id LIMIT 10")
def embedding_topk(t):
    e = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    q = F.broadcast(e.filter("vec_id = 0").select(F.col("e").alias("q")))
    score = F.aggregate(F.zip_with("e", "q", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return e.filter("vec_id <> 0").crossJoin(q).select("vec_id", score.alias("s")).orderBy(F.desc("s"), "vec_id").limit(10).select("vec_id", r6("s").alias("score"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


from lodestone.plans import formula_queries, frame_queries, geometry_queries, raster_queries, stats_queries  # noqa: E402, F401
