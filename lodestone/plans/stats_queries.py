"""Queries on statistics of places, classification, decisions over criteria, and networks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import classify, network, stats
from lodestone.plans.catalog import DIST, GRID, POINTS, query

_W = f"{POINTS}, w AS (SELECT a.id AS i, b.id AS j, a.v AS vi, b.v AS vj, {DIST} AS d, 1.0::DOUBLE AS w FROM p a JOIN p b ON a.id <> b.id AND {DIST} <= 0.05), m AS (SELECT avg(v) AS mean, var_pop(v) AS var, stddev_pop(v) AS s, count(v) AS n FROM p)"


def _weights(t):
    return stats.weights(t.points(), bandwidth=0.05)


# Classes.


@query("WITH b AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi, avg(c_acctbal) AS mean, stddev_pop(c_acctbal) AS sd, min(c_acctbal) FILTER (WHERE c_acctbal > 0) AS pos FROM customer), k AS (SELECT unnest(range(1, 5)) AS k) SELECT 'equal_interval' AS scheme, lo + (hi - lo) / 5 * k AS break FROM b, k UNION ALL SELECT 'geometric_interval', pos * pow(pow(hi / pos, 1 / 5.0::DOUBLE), k) FROM b, k UNION ALL SELECT 'standard_deviation', mean + j * sd FROM b, (SELECT unnest([-2, -1, 0, 1, 2]) AS j) UNION ALL SELECT 'defined_interval', lo + 1000.0 * j FROM b, (SELECT unnest(range(1, 100)) AS j) WHERE lo + 1000.0 * j < hi")
def class_breaks(t):
    c = t.customer
    found = {"equal_interval": classify.equal_interval(c, "c_acctbal"), "geometric_interval": classify.geometric_interval(c, "c_acctbal"), "standard_deviation": classify.standard_deviation(c, "c_acctbal"), "defined_interval": classify.defined_interval(c, "c_acctbal", 1000.0)}
    return t.spark.createDataFrame([(k, float(b)) for k, v in found.items() for b in v], "scheme string, break double")


@query("WITH r AS (SELECT c_acctbal AS v, row_number() OVER (ORDER BY c_acctbal) - 1 AS k, count(*) OVER () AS n FROM customer), q AS (SELECT quantile_cont(c_acctbal, 0.25) AS a, quantile_cont(c_acctbal, 0.5) AS b, quantile_cont(c_acctbal, 0.75) AS c FROM customer) SELECT 'quantile' AS scheme, v AS break FROM r, (SELECT unnest(range(1, 5)) AS i) WHERE k = i * n // 5 UNION ALL SELECT 'box_plot', unnest([a - 1.5 * (c - a), a, b, c, c + 1.5 * (c - a)]) FROM q UNION ALL SELECT 'percentile', unnest(quantile_cont(c_acctbal, [0.1, 0.9])) FROM customer")
def rank_breaks(t):
    c = t.customer
    found = {"quantile": classify.quantile(c, "c_acctbal"), "box_plot": classify.box_plot(c, "c_acctbal"), "percentile": classify.percentile(c, "c_acctbal", (0.1, 0.9))}
    return t.spark.createDataFrame([(k, float(b)) for k, v in found.items() for b in v], "scheme string, break double")


@query("WITH g AS (SELECT DISTINCT p_retailprice AS v FROM part), d AS (SELECT v, v - lag(v) OVER (ORDER BY v) AS gap FROM g) SELECT v - gap / 2 AS break FROM d WHERE gap IS NOT NULL ORDER BY gap DESC, v LIMIT 4")
def maximum_breaks(t):
    return t.spark.createDataFrame([(float(b),) for b in classify.maximum_breaks(t.part, "p_retailprice")], "break double")


@query("WITH RECURSIVE h(k, mean, n, m) AS (SELECT 1, avg(p_retailprice), count(*), (SELECT count(*) FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part)) FROM part UNION ALL SELECT h.k + 1, (SELECT avg(p_retailprice) FROM part WHERE p_retailprice > h.mean), h.m, (SELECT count(*) FROM part WHERE p_retailprice > (SELECT avg(q.p_retailprice) FROM part q WHERE q.p_retailprice > h.mean)) FROM h WHERE h.m > 1 AND h.m / h.n <= 0.4 AND h.k < 40) SELECT mean AS break FROM h WHERE m > 0 AND m < n")
def head_tail_breaks(t):
    return t.spark.createDataFrame([(float(b),) for b in classify.head_tail(t.part, "p_retailprice")], "break double")


@query("WITH c AS (SELECT p_size AS v, count(*)::DOUBLE AS n, sum(p_size)::DOUBLE AS s, sum(p_size * p_size)::DOUBLE AS q FROM part GROUP BY 1), e AS (SELECT a.v AS lo, b.v AS hi, (SELECT sum(q) - sum(s) * sum(s) / sum(n) FROM c WHERE v BETWEEN a.v AND b.v) AS ssd FROM c a JOIN c b ON b.v >= a.v), edge AS (SELECT min(v) AS lo, max(v) AS hi FROM c), nxt AS (SELECT v, lead(v) OVER (ORDER BY v) AS nv FROM c), three AS (SELECT x.hi AS h1, y.lo AS b1, z.lo AS b2, x.ssd + y.ssd + z.ssd AS total FROM edge, e x, nxt n1, e y, nxt n2, e z WHERE x.lo = edge.lo AND n1.v = x.hi AND y.lo = n1.nv AND n2.v = y.hi AND z.lo = n2.nv AND z.hi = edge.hi) SELECT unnest([b1, b2])::DOUBLE AS break FROM (SELECT * FROM three ORDER BY total, b2, b1 LIMIT 1)")
def natural_breaks(t):
    return t.spark.createDataFrame([(float(b),) for b in classify.natural_breaks(t.part, "p_size", 3)], "break double")


@query("SELECT p_partkey, ((p_size > 10)::BIGINT + (p_size > 25)::BIGINT + (p_size > 40)::BIGINT) AS class FROM part")
def manual_classes(t):
    return t.part.select("p_partkey", classify.class_of(F.col("p_size"), [10, 25, 40]).alias("class"))


# Weights and statistics.


@query(f"WITH {POINTS} SELECT a.id AS i, b.id AS j, exp(-pow({DIST} / 0.02, 2) / 2) AS gaussian FROM p a JOIN p b ON a.id <> b.id AND {DIST} <= 0.06")
def kernel_weights(t):
    return stats.kernel_weights(t.points(), 0.02).select("i", "j", F.col("w").alias("gaussian"))


@query(f"WITH {_W} SELECT i, j, 1 / d AS w, (1 / d) / sum(1 / d) OVER (PARTITION BY i) AS std FROM w WHERE d > 0")
def inverse_distance_weights(t):
    return stats.standardized_inverse_distance_weights(t.points(), 0.05).select("i", "j", "w", "std")


@query(f"WITH {_W}, lag AS (SELECT i, avg(vj) AS mv FROM w GROUP BY 1), r AS (SELECT p.id, p.v - mean AS d, var, coalesce(mv - mean, 0) AS lag FROM p CROSS JOIN m LEFT JOIN lag ON lag.i = p.id), l AS (SELECT *, d / var * lag AS li FROM r) SELECT id, li AS local_i, li / sqrt(var) AS z_score, CASE WHEN abs(li / sqrt(var)) < 1.96 THEN 'NS' WHEN d > 0 AND lag > 0 THEN 'HH' WHEN d < 0 AND lag < 0 THEN 'LL' WHEN d > 0 AND lag < 0 THEN 'HL' ELSE 'LH' END AS cluster_type FROM l")
def local_morans(t):
    return stats.local_morans(t.points(), _weights(t))


@query(f"WITH {_W}, g AS (SELECT p.id, 1 + count(j) AS sw, 1 + count(j) AS sw2, p.v + coalesce(sum(vj), 0) AS swx FROM p LEFT JOIN w ON w.i = p.id GROUP BY p.id, p.v), z AS (SELECT id, (swx - mean * sw) / (s * sqrt((n * sw2 - sw * sw) / (n - 1))) AS g FROM g, m) SELECT id, g AS gi_star, CASE WHEN abs(g) >= 2.576 THEN CASE WHEN g > 0 THEN 'Hot (99%)' ELSE 'Cold (99%)' END WHEN abs(g) >= 1.96 THEN CASE WHEN g > 0 THEN 'Hot (95%)' ELSE 'Cold (95%)' END WHEN abs(g) >= 1.6449 THEN CASE WHEN g > 0 THEN 'Hot (90%)' ELSE 'Cold (90%)' END ELSE 'Not Significant' END AS confidence_bin FROM z")
def hot_spots(t):
    return stats.hot_spots(t.points(), _weights(t)).drop("p_value")


@query(f"WITH {_W}, s AS (SELECT sum(w) AS s0, sum((vi - mean) * (vj - mean)) AS c FROM w, m), sym AS (SELECT i, j, sum(w) AS w FROM (SELECT i, j, w FROM w UNION ALL SELECT j, i, w FROM w) GROUP BY 1, 2), q AS (SELECT (SELECT sum(w * w) / 2 FROM sym) AS s1, (SELECT sum(x * x) FROM (SELECT sum(w) AS x FROM sym GROUP BY i)) AS s2), k AS (SELECT avg(pow(v - mean, 4)) / pow(any_value(var), 2) AS k2 FROM p, m), r AS (SELECT n / s0 * c / (var * n) AS mi, -1.0::DOUBLE / (n - 1) AS e, ((n * ((n * n - 3 * n + 3) * s1 - n * s2 + 3 * s0 * s0)) - k2 * ((n * n - n) * s1 - 2 * n * s2 + 6 * s0 * s0)) / ((n - 1.0::DOUBLE) * (n - 2) * (n - 3) * s0 * s0) - pow(-1.0::DOUBLE / (n - 1), 2) AS var FROM s, m, q, k) SELECT mi AS morans_i, e AS expected_i, (mi - e) / sqrt(var) AS z_score FROM r")
def morans_i_test(t):
    return stats.morans_i_test(t.points(), _weights(t), symmetric=True)


@query(f"WITH {_W} SELECT sum(vi * vj) / (SELECT sum(v) * sum(v) - sum(v * v) FROM p) AS general_g FROM w")
def general_g(t):
    return stats.general_g(t.points(), _weights(t))


@query(f"WITH {_W} SELECT count(*) FILTER (WHERE vi > 0 AND vj > 0) / 2.0::DOUBLE AS bb, count(*) FILTER (WHERE (vi > 0) <> (vj > 0)) / 2.0::DOUBLE AS bw, count(*) FILTER (WHERE NOT vi > 0 AND NOT vj > 0) / 2.0::DOUBLE AS ww FROM w")
def join_counts(t):
    return stats.join_counts(t.points(), _weights(t))


@query(f"WITH {_W}, a AS (SELECT i, avg(vj) AS mv, count(*) AS k, min(vj) AS lo, max(vj) AS hi, avg(pow(vi - vj, 2)) AS sq FROM w GROUP BY 1) SELECT a.i AS id, k AS n, mv AS mean, lo AS min, hi AS max, sq / var AS local_c FROM a, m")
def neighborhood_statistics(t):
    w = _weights(t)
    return stats.neighborhood_statistics(t.points(), w).drop("std").join(stats.local_geary(t.points(), w), "id")


@query(f"WITH {_W}, l AS (SELECT p.id, p.v, coalesce(avg(vj), 0) AS lm FROM p LEFT JOIN w ON w.i = p.id GROUP BY 1, 2), o AS (SELECT avg(abs(v - lm)) AS a, stddev_pop(abs(v - lm)) AS s FROM l) SELECT id, lm AS local_mean, abs(v - lm) AS deviation, abs(abs(v - lm) - a) / s > 2 AS is_outlier FROM l, o")
def spatial_outliers(t):
    return stats.spatial_outliers(t.points(), _weights(t))


@query(f"WITH {POINTS}, k AS (SELECT a.id, exp(-pow({DIST} / 0.02, 2) / 2) AS w, b.v FROM p a JOIN p b ON {DIST} <= 0.06), r AS (SELECT id, sum(w * v) / sum(w) AS mean, sum(w * v * v) / sum(w) AS q FROM k GROUP BY 1) SELECT id, mean AS local_mean, sqrt(greatest(0, q - mean * mean)) AS local_std FROM r")
def weighted_summary(t):
    return stats.weighted_summary(t.points(), 0.02)


@query(f"WITH {POINTS}, near AS (SELECT a.id, min({DIST}) AS d FROM p a JOIN p b ON a.id <> b.id GROUP BY 1), r AS (SELECT avg(d) AS o, count(*)::DOUBLE AS n, 0.5 / sqrt(count(*) / 1.0::DOUBLE) AS e FROM near) SELECT o AS observed, e AS expected, o / e AS ratio, (o - e) / (0.26136 / sqrt(n * n)) AS z_score FROM r")
def average_nearest_neighbor(t):
    return stats.average_nearest_neighbor(t.points(), 1.0)


@query(f"WITH {POINTS}, q AS (SELECT unnest([0.02, 0.05]::DOUBLE[]) AS d), c AS (SELECT q.d, count(*) AS c FROM q, p a JOIN p b ON a.id <> b.id WHERE {DIST} <= q.d GROUP BY 1) SELECT d, sqrt(c / ((SELECT count(*) FROM p) * (SELECT count(*) FROM p))::DOUBLE / pi()) - d AS l FROM c")
def ripley_l(t):
    return stats.ripley_l(t.points(), [0.02, 0.05], 1.0)


@query(f"WITH {POINTS} SELECT floor(x / 0.1)::BIGINT AS cx, floor(y / 0.1)::BIGINT AS cy, count(*) / 0.01::DOUBLE AS density FROM p GROUP BY 1, 2")
def point_density(t):
    return stats.point_density(t.points(), 0.1)


@query(f"WITH {POINTS}, c AS (SELECT id, x, y, floor(x / 0.05)::BIGINT + i AS cx, floor(y / 0.05)::BIGINT + j AS cy FROM p, (SELECT unnest(range(-4, 5)) AS i), (SELECT unnest(range(-4, 5)) AS j)), far AS (SELECT cx, cy, pow(x - (cx + 0.5::DOUBLE) * 0.05::DOUBLE, 2) + pow(y - (cy + 0.5::DOUBLE) * 0.05::DOUBLE, 2) AS d2 FROM c) SELECT cx, cy, sum(exp(-d2 / (2 * 0.0025::DOUBLE))) / (2 * pi() * 0.0025::DOUBLE) AS density FROM far WHERE d2 <= 0.0225::DOUBLE GROUP BY 1, 2")
def kernel_density(t):
    return stats.kernel_density(t.points(), 0.05, 0.05)


@query(f"WITH {POINTS}, r AS (SELECT avg(x) AS cx, avg(y) AS cy, var_pop(x) AS a, var_pop(y) AS b, covar_pop(x, y) AS c FROM p) SELECT cx AS center_x, cy AS center_y, sqrt((a + b) / 2 + sqrt(pow((a - b) / 2, 2) + c * c)) AS semi_major, sqrt((a + b) / 2 - sqrt(pow((a - b) / 2, 2) + c * c)) AS semi_minor, degrees(atan2(2 * c, a - b) / 2) AS rotation FROM r")
def deviational_ellipse(t):
    return stats.deviational_ellipse(t.points())


@query("WITH l AS (SELECT atan2(embedding[3]::DOUBLE - embedding[1]::DOUBLE, embedding[4]::DOUBLE - embedding[2]::DOUBLE) AS b FROM embeddings) SELECT ((degrees(atan2(avg(sin(b)), avg(cos(b)))) % 360) + 360) % 360 AS direction, sqrt(pow(avg(sin(b)), 2) + pow(avg(cos(b)), 2)) AS strength FROM l")
def directional_mean(t):
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return stats.directional_mean(t.embeddings.select(at(0).alias("x1"), at(1).alias("y1"), at(2).alias("x2"), at(3).alias("y2")))


@query("SELECT regr_intercept(l_extendedprice, l_quantity) AS intercept, regr_slope(l_extendedprice, l_quantity) AS slope, regr_r2(l_extendedprice, l_quantity) AS r_squared FROM lineitem")
def linear_regression(t):
    r = stats.linear_regression(t.lineitem, "l_extendedprice", ["l_quantity"])
    return t.spark.createDataFrame([(r["intercept"], r["l_quantity"], r["r_squared"])], "intercept double, slope double, r_squared double")


@query(f"WITH RECURSIVE {POINTS}, e AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON {DIST} <= 0.03), c(a, b) AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a), l AS (SELECT a AS id, min(b) AS k FROM c GROUP BY 1), n AS (SELECT k, count(*) AS n FROM l GROUP BY 1) SELECT id, CASE WHEN n >= 3 THEN l.k ELSE -1 END AS cluster FROM l JOIN n USING (k)")
def distance_clusters(t):
    return stats.distance_clusters(t.points(), 0.03, 3)


@query(f"WITH RECURSIVE {POINTS}, n AS (SELECT a.id AS a, b.id AS b, {DIST} AS d FROM p a JOIN p b ON a.id <> b.id AND {DIST} <= 0.05), core AS (SELECT a FROM n GROUP BY a HAVING count(*) >= 4), e AS (SELECT n.a, n.b FROM n JOIN core x ON x.a = n.a JOIN core y ON y.a = n.b UNION SELECT a, a FROM core), c(a, b) AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a), l AS (SELECT a AS id, min(b) AS k FROM c GROUP BY 1), border AS (SELECT n.b AS id, arg_min(l.k, struct_pack(d := n.d, i := n.a)) AS k FROM n JOIN l ON l.id = n.a WHERE n.b NOT IN (SELECT a FROM core) GROUP BY 1), u AS (SELECT * FROM l UNION ALL SELECT * FROM border) SELECT p.id, coalesce(u.k, -1) AS cluster FROM p LEFT JOIN u USING (id)")
def dbscan(t):
    return stats.dbscan(t.points(), 0.05, 4)


# Decisions.

_PART = "SELECT p_partkey AS id, p_size::DOUBLE AS a, p_retailprice AS b, 1 / (1 + p_size / 50.0::DOUBLE) AS f, p_retailprice / 3000 AS g FROM part"


def _parts(t):
    return t.part.select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b"), (1 / (1 + F.col("p_size") / 50)).alias("f"), (F.col("p_retailprice") / 3000).alias("g"))


@query(f"WITH x AS ({_PART}) SELECT id, 0.3::DOUBLE * f + 0.7::DOUBLE * g AS wsum, pow(f, 0.3::DOUBLE) * pow(g, 0.7::DOUBLE) AS wproduct, least(f, g) AS fand, greatest(f, g) AS forr, f * g AS fproduct, 1 - (1 - f) * (1 - g) AS fsum, pow(1 - (1 - f) * (1 - g), 0.9::DOUBLE) * pow(f * g, 0.1::DOUBLE) AS fgamma, f > 0.6 AND g > 0.4 AS band, f > 0.6 OR g > 0.4 AS bor, NOT f > 0.6 AS bnot FROM x")
def overlay_scores(t):
    f, g = F.col("f"), F.col("g")
    fuzzy, boolean = (lambda m: stats.fuzzy_overlay([f, g], m)), (lambda m: stats.boolean_overlay([f > 0.6, g > 0.4], m))
    return _parts(t).select(
        "id", stats.weighted_sum({"f": 0.3, "g": 0.7}).alias("wsum"), stats.weighted_product({"f": 0.3, "g": 0.7}).alias("wproduct"), fuzzy("and").alias("fand"), fuzzy("or").alias("forr"),
        fuzzy("product").alias("fproduct"), fuzzy("sum").alias("fsum"), fuzzy("gamma").alias("fgamma"), boolean("and").alias("band"), boolean("or").alias("bor"), boolean("not").alias("bnot"),
    )


@query(f"WITH x AS ({_PART}), o AS (SELECT sqrt(sum(a * a)) AS na, sqrt(sum(b * b)) AS nb, min(a) AS la, max(a) AS ha, min(b) AS lb, max(b) AS hb FROM x), d AS (SELECT id, sqrt(pow((a - ha) / na * 0.4::DOUBLE, 2) + pow((b - lb) / nb * 0.6::DOUBLE, 2)) AS up, sqrt(pow((a - la) / na * 0.4::DOUBLE, 2) + pow((b - hb) / nb * 0.6::DOUBLE, 2)) AS down, 0.4::DOUBLE * (a - la) / (ha - la) + 0.6::DOUBLE * (1 - (b - lb) / (hb - lb)) AS score FROM x, o) SELECT id, down / (up + down) AS closeness, score FROM d")
def topsis(t):
    x = stats.topsis(_parts(t), {"a": 2.0, "b": 3.0}, ("b",))
    return stats.normalized_score(x, {"a": 2.0, "b": 3.0}, ("b",)).select("id", "closeness", "score")


@query(f"WITH x AS ({_PART}), s AS (SELECT stddev_pop(a) AS sa, stddev_pop(b) AS sb FROM x) SELECT id, sqrt(pow((a - 20) / sa, 2) + pow((b - 1200) / sb, 2)) AS distance FROM x, s ORDER BY 2, 1 LIMIT 15")
def similarity_search(t):
    return stats.similarity_search(_parts(t), {"a": 20.0, "b": 1200.0}, 15)


@query("WITH r AS (SELECT p_retailprice AS v, row_number() OVER (ORDER BY p_retailprice) AS k, count(*) OVER () AS n FROM part) SELECT 2 * sum(k * v) / (any_value(n) * sum(v)) - (any_value(n) + 1) / any_value(n)::DOUBLE AS gini, avg((v > 1500)::INTEGER) AS above FROM r")
def gini_and_probability(t):
    above = stats.probability_above(t.part, "p_retailprice", 1500.0).head()[0]
    return t.spark.createDataFrame([(stats.gini(t.part, "p_retailprice"), above)], "gini double, above double")


@query("SELECT c_nationkey, c_mktsegment, count(*) AS count, sum(c_acctbal) AS sum, avg(c_acctbal) AS mean, min(c_acctbal) AS min, max(c_acctbal) AS max FROM customer GROUP BY 1, 2")
def zonal_by_class(t):
    return stats.zonal_by_class(t.customer, "c_nationkey", "c_acctbal", "c_mktsegment")


@query(f"WITH {POINTS}, k AS (SELECT a.id, b.id AS d, a.v + 1 AS cap, b.v + 1 AS pop, exp(-pow({DIST} / 0.05, 2) / 2) AS w FROM f a JOIN d b ON {DIST} <= 0.1), r AS (SELECT id, any_value(cap) / sum(pop * w) AS r FROM k GROUP BY 1), s AS (SELECT d, sum(r * w) AS s FROM k JOIN r USING (id) GROUP BY 1) SELECT d.id, coalesce(s, 0) AS score FROM d LEFT JOIN s ON s.d = d.id")
def enhanced_catchment(t):
    return stats.enhanced_catchment(t.facilities().withColumn("capacity", F.col("v") + 1), t.demand().withColumn("population", F.col("v") + 1), 0.1, 0.05)


@query(f"WITH {POINTS}, r AS (SELECT (sqrt(x * x + y * y) > 0.05)::BIGINT + (sqrt(x * x + y * y) > 0.1)::BIGINT + (sqrt(x * x + y * y) > 0.2)::BIGINT AS ring FROM p) SELECT ring, count(*) AS customers, count(*) / sum(count(*)) OVER () AS share FROM r GROUP BY 1")
def market_penetration(t):
    return stats.market_penetration(t.points(), 0.0, 0.0, [0.05, 0.1, 0.2])


@query(f"WITH {POINTS}, q AS (SELECT quantile_cont(sqrt(x * x + y * y), [0.5, 0.8]) AS q FROM p) SELECT unnest([0.5, 0.8])::DOUBLE AS share, unnest(q) AS radius FROM q")
def trade_area(t):
    return stats.trade_area(t.points(), 0.0, 0.0, [0.5, 0.8])


# Networks.

_REACH = f"{GRID}, s(node, cost) AS (SELECT 0::BIGINT, 0.0::DOUBLE UNION SELECT e.dst, s.cost + e.cost FROM s JOIN e ON s.node = e.src), c AS (SELECT node, min(cost) AS cost FROM s GROUP BY 1)"


def _node(t, *nodes):
    return t.spark.createDataFrame([(n,) for n in nodes], "node long")


@query(f"WITH RECURSIVE {_REACH} SELECT c.node, c.cost, min(e.src) AS prev FROM c LEFT JOIN (SELECT e.*, c.cost + e.cost AS total FROM e JOIN c ON c.node = e.src) e ON e.dst = c.node AND e.total = c.cost GROUP BY 1, 2")
def shortest_tree(t):
    return network.shortest_tree(t.grid(), _node(t, 0)).select("node", "cost", "prev")


@query(f"WITH RECURSIVE {_REACH}, tree AS (SELECT c.node, c.cost, min(e.src) AS prev FROM c LEFT JOIN (SELECT e.*, c.cost + e.cost AS total FROM e JOIN c ON c.node = e.src) e ON e.dst = c.node AND e.total = c.cost GROUP BY 1, 2), path AS (SELECT * FROM tree WHERE node = 143 UNION ALL SELECT tree.* FROM path JOIN tree ON tree.node = path.prev) SELECT node, prev, cost FROM path")
def shortest_path(t):
    return network.shortest_path(t.grid(), 0, 143)


@query(f"WITH RECURSIVE {_REACH}, tree AS (SELECT c.node, c.cost, min(e.src) AS prev FROM c LEFT JOIN (SELECT e.*, c.cost + e.cost AS total FROM e JOIN c ON c.node = e.src) e ON e.dst = c.node AND e.total = c.cost GROUP BY 1, 2), path(goal, node, prev) AS (SELECT node, node, prev FROM tree WHERE node % 5 = 0 UNION ALL SELECT path.goal, tree.node, tree.prev FROM path JOIN tree ON tree.node = path.prev), load AS (SELECT prev AS src, node AS dst, sum(goal % 7 + 1)::DOUBLE AS load FROM path WHERE prev IS NOT NULL GROUP BY 1, 2) SELECT e.src, e.dst, coalesce(load, 0) AS load, pow(coalesce(load, 0) / (20 * e.cost), 2) AS stress FROM e LEFT JOIN load ON load.src = e.src AND load.dst = e.dst")
def bottlenecks(t):
    demands = t.spark.range(0, 144, 5).select(F.lit(0).cast("long").alias("origin"), F.col("id").alias("end"), (F.col("id") % 7 + 1).cast("double").alias("demand"))
    return network.bottlenecks(t.grid().withColumn("capacity", 20 * F.col("cost")), demands).select("src", "dst", "load", "stress")


@query(f"WITH RECURSIVE {GRID}, s(origin, node, cost) AS (SELECT n, n, 0.0::DOUBLE FROM (SELECT unnest([0, 7, 60])::BIGINT AS n) UNION SELECT s.origin, e.dst, s.cost + e.cost FROM s JOIN e ON s.node = e.src), c AS (SELECT origin, node, min(cost) AS cost FROM s GROUP BY 1, 2), b AS (SELECT node, arg_min(origin, struct_pack(c := cost, o := origin)) AS assigned, min(cost) AS least_cost FROM c GROUP BY 1) SELECT g.a AS node, assigned, least_cost, (g.a % 4 + 1)::DOUBLE AS demand, CASE WHEN assigned IS NULL THEN 0 ELSE (g.a % 4 + 1)::DOUBLE END AS delivered, CASE WHEN assigned IS NULL THEN 1.0::DOUBLE ELSE 0 END AS service_deficit, assigned IS NOT NULL AS reachable FROM g LEFT JOIN b ON b.node = g.a")
def allocate_demand(t):
    supply = t.spark.createDataFrame([(0, 5.0), (7, 1.0), (60, 2.0), (100, 0.0)], "node long, supply double")
    return network.allocate_demand(t.grid(), supply, t.spark.range(144).select(F.col("id").alias("node"), (F.col("id") % 4 + 1).cast("double").alias("demand")))


_CUT = f"{GRID}, k AS (SELECT src, dst FROM e WHERE cost < 3)"


@query(f"WITH RECURSIVE {_CUT}, u AS (SELECT src AS a, dst AS b FROM k UNION SELECT dst, src FROM k UNION SELECT src, src FROM k UNION SELECT dst, dst FROM k), c(a, b) AS (SELECT a, b FROM u UNION SELECT c.a, u.b FROM c JOIN u ON c.b = u.a) SELECT a AS node, min(b) AS component FROM c GROUP BY 1")
def components(t):
    return network.components(t.grid().filter("cost < 3"))


@query("WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS a, -l_partkey AS b FROM lineitem WHERE l_quantity = 50 AND l_tax = 0.08), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), c(a, b) AS (SELECT a, a FROM u UNION SELECT c.a, u.b FROM c JOIN u ON c.b = u.a) SELECT a AS node, min(b) AS component FROM c GROUP BY 1")
def supplier_part_components(t):
    return network.components(t.lineitem.filter("l_quantity = 50 and l_tax = 0.08").select(F.col("l_suppkey").alias("src"), (-F.col("l_partkey")).alias("dst")))


@query(f"WITH RECURSIVE {_CUT}, s(node, d) AS (SELECT 0::BIGINT, 0::BIGINT UNION SELECT k.dst, s.d + 1 FROM s JOIN k ON k.src = s.node WHERE s.d < 6) SELECT node, min(d) AS depth FROM s GROUP BY 1")
def trace(t):
    return network.trace(t.grid().filter("cost < 3"), _node(t, 0), 6)


@query(f"WITH RECURSIVE {_CUT}, u AS (SELECT src AS a, dst AS b FROM k UNION SELECT dst, src FROM k), c(a, b) AS (SELECT a, a FROM u UNION SELECT c.a, u.b FROM c JOIN u ON c.b = u.a), l AS (SELECT a, min(b) AS m FROM c GROUP BY 1), d AS (SELECT a, count(*) AS n FROM u GROUP BY 1) SELECT (SELECT count(*) FROM k) AS edges, 0::BIGINT AS self_loops, (SELECT count(*) FROM l) AS nodes, (SELECT count(DISTINCT m) FROM l) AS components, 0::BIGINT AS duplicate_pairs, (SELECT count(*) FROM d WHERE n = 1) AS dead_ends")
def topology(t):
    return network.topology(t.grid().filter("cost < 3"))


@query(f"WITH {GRID} SELECT src, dst, cost * 2 + cost * 0.5::DOUBLE * (src % 3) + cost * (1 - least(1, greatest(0, (dst % 4) / 2.0::DOUBLE))) AS impedance, cost * CASE WHEN src % 10 = 0 THEN 1.5::DOUBLE ELSE 1 END + CASE WHEN src % 10 = 0 THEN 2 ELSE 0 END AS traffic, CASE WHEN src % 2 = 0 THEN cost ELSE cost * 1.5::DOUBLE END AS preferred FROM e")
def edge_costs(t):
    g = t.grid()
    feed = g.filter("src % 10 = 0").select("src", "dst", F.lit(1.5).alias("speed_factor"), F.lit(2.0).alias("delay"))
    a = g.select("src", "dst", network.impedance(F.col("cost"), slope=F.col("src") % 3, condition=F.col("dst") % 4 / 2.0, weights={"base": 2.0, "slope": 0.5, "condition_penalty": 1.0}).alias("impedance"))
    b = network.with_traffic(g, feed).select("src", "dst", F.col("cost").alias("traffic"))
    c = network.preferring(g.withColumn("k", (F.col("src") % 2).cast("string")), "k", ["0"]).select("src", "dst", F.col("cost").alias("preferred"))
    return a.join(b, ["src", "dst"]).join(c, ["src", "dst"])


@query(f"WITH RECURSIVE {_REACH} SELECT a.node AS origin, b.node AS \"end\", abs(a.cost - b.cost) AS bound FROM c a JOIN c b ON b.node = a.node + 13")
def landmark_bounds(t):
    pairs = t.spark.range(0, 131).select(F.col("id").alias("origin"), (F.col("id") + 13).alias("end"))
    return network.landmark_bounds(network.landmark_index(t.grid(), _node(t, 0)), pairs)


@query(f"WITH RECURSIVE {GRID}, s(origin, node, cost) AS (SELECT n, n, 0.0::DOUBLE FROM (SELECT unnest([0, 3, 12])::BIGINT AS n) UNION SELECT s.origin, e.dst, s.cost + e.cost FROM s JOIN e ON s.node = e.src), c AS (SELECT origin, node, min(cost) AS cost FROM s WHERE node % 9 = 0 GROUP BY 1, 2) SELECT node, origin AS facility, cost, row_number() OVER (PARTITION BY node ORDER BY cost, origin) AS rank FROM c QUALIFY rank <= 2")
def closest_facility(t):
    return network.closest_facility(t.grid(), t.spark.range(0, 144, 9).select(F.col("id").alias("node")), _node(t, 0, 3, 12), 2)


@query("WITH e AS (SELECT event_type AS s, value AS h, user_id % 5 + 1 AS i FROM events), r AS (SELECT s, sum(i) / 1000.0::DOUBLE AS saifi, sum(i * h) / 1000.0::DOUBLE AS saidi, sum(i * h) / sum(i) AS caidi FROM e GROUP BY 1), b AS (SELECT * FROM r WHERE s = 'click') SELECT r.s AS scenario, r.saifi, r.saidi, r.caidi, r.saifi - b.saifi AS saifi_delta, r.saidi - b.saidi AS saidi_delta, r.caidi - b.caidi AS caidi_delta FROM r, b")
def scenario_reliability(t):
    e = t.events.select(F.col("event_type").alias("scenario"), F.col("value").alias("hours"), (F.col("user_id") % 5 + 1).alias("impacted"))
    return network.scenario_reliability(e, 1000.0, "click")
