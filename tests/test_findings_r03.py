"""Queries that failed or grew too fast in round 3: by plan, by plain loops and against what they gave before."""

import math

import pytest
from pyspark.sql import functions as F

import oracle
from lodestone import scratch
from lodestone.frame import Table
from lodestone.functions import geometry as geo
from lodestone.operators import spatial, stats
from lodestone.plans import catalog, geometry_queries


def plan(df):
    return df._jdf.queryExecution().toString()


def places(spark, n, seed=1, spread=1.0, start=0):
    return scratch.written(spark.range(start, start + n, 1, 4).select("id", (F.rand(seed) * spread).alias("x"), (F.rand(seed + 1) * spread).alias("y"), (F.col("id") % 7).cast("double").alias("v")))


def test_all_pairs_are_spread_over_tasks(spark):
    one = places(spark, 300).coalesce(1)
    pairs = spatial.all_pairs(one, one, "b")
    assert pairs.count() == 90_000
    assert pairs.rdd.getNumPartitions() >= 8 and "Exchange" not in plan(pairs.select("id")).split("Physical Plan")[1].split("BroadcastNestedLoopJoin")[0]


def test_pressure_by_loops(spark, monkeypatch):
    rows = [(i, (i * 37 % 101) / 101, (i * 53 % 97) / 97, float(i % 5)) for i in range(200)] + [(7, 0.5, 0.5, 2.0), (500, None, 0.1, 1.0), (501, 0.2, 0.2, None)]
    points = spark.createDataFrame(rows, "id long, x double, y double, v double")
    want = {}
    for i, x, y, _ in rows:
        got = [v / (1 + math.dist((x, y), (p, q)) / 0.1) ** 2 for j, p, q, v in rows if j != i and None not in (x, p, q, v)]
        want[i] = want.get(i, 0) + sum(got) if got else want.get(i)
    for most in (scratch.BROADCAST_BYTES, 2_000):
        monkeypatch.setattr(stats, "BROADCAST_BYTES", most)
        found = stats.neighborhood_pressure(points, 0.1)
        assert "MapInArrow" in plan(found)
        got = {r.id: r.pressure for r in found.collect()}
        assert got.pop(500) is None and want[500] is None
        assert got == pytest.approx({k: v for k, v in want.items() if k != 500})


def test_huff_shuffles_no_pairs(spark):
    shares = stats.huff(places(spark, 20).withColumn("size", F.col("v") + 1), places(spark, 50, 5, start=100))
    assert "Window" not in plan(shares)
    assert all(abs(r.s - 1) < 1e-9 and r.n == 20 for r in shares.groupBy("id").agg(F.sum("probability").alias("s"), F.count("*").alias("n")).collect())


def test_standardized_weights_join_no_pairs(spark):
    points = places(spark, 300)
    w = stats.inverse_distance_weights(points, 0.2)
    want = {(r.i, r.j): r.w for r in stats.row_standardized(w).collect()}
    found = catalog.queries()["inverse_distance_weights"](spark, f"{oracle.DATA}/sf0.001")
    assert "[i#" not in "".join(x for x in plan(found).split("Physical Plan")[1].splitlines() if "Join [" in x)
    assert {(r.i, r.j): r.std for r in stats.standardized_inverse_distance_weights(points, 0.2).collect()} == pytest.approx(want)


def test_morans_test_of_symmetric_weights(spark):
    points = places(spark, 300)
    w = scratch.written(stats.weights(points, bandwidth=0.2))
    one, other = (stats.morans_i_test(points, w, symmetric=x) for x in (True, False))
    assert "hashpartitioning(i" in plan(one) and "hashpartitioning(i#" in plan(one) and "Union" not in plan(one)
    assert one.head() == pytest.approx(other.head())


def test_nearest_within_a_distance_searches_near_first(spark, monkeypatch):
    left, right = places(spark, 40), places(spark, 4000, 5, start=100)
    p, q = left.collect(), right.collect()
    want = {(a.id, b.id) for a in p for b in sorted((b for b in q if math.dist((a.x, a.y), (b.x, b.y)) <= 0.2), key=lambda b: (math.dist((a.x, a.y), (b.x, b.y)), str(b.id)))[:2]}
    sizes = []
    pairs = spatial.within_distance_pairs
    monkeypatch.setattr(spatial, "within_distance_pairs", lambda a, b, size, suffix: sizes.append(size) or pairs(a, b, size, suffix))
    assert {(r.id, r.id_right) for r in spatial.nearest_join(left, right, 2, "left", 0.2).collect()} == want
    assert sizes[0] < 0.1 and max(sizes) <= 0.2


def test_ranks_take_so_many_rows_a_task(spark):
    rows = spark.range(0, 5000, 1, 3).select((F.col("id") % 100).alias("k"))
    assert scratch.dealt(rows, "k", each=500).rdd.getNumPartitions() == 10
    assert "REPARTITION_BY_NUM" in plan(catalog.queries()["rank_methods"](spark, f"{oracle.DATA}/sf0.001"))


def test_first_of_equal_extremes(spark):
    t = Table(spark.createDataFrame([(k, float(v) if v else None) for k, v in enumerate((3, 0, 1, 5, 1, 5, 1))], "k long, v double").repartition(4), order="k")
    assert (t.idxmin("v"), t.idxmax("v")) == (2, 3)


def test_rows_of_shapes_are_spread(spark, tmp_path):
    """One file of one row group is not one task."""
    spark.read.parquet(f"{oracle.DATA}/sf0.01/part.parquet").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    assert geometry_queries._x(catalog.Tables(spark, str(tmp_path))).rdd.getNumPartitions() > 1


def test_shapes_of_a_turn_are_worked_out_once(spark):
    box = geo.rectangle(F.lit(0.0), F.lit(0.0), F.col("id"), F.lit(2.0))
    turned = spark.range(1, 5).select(geo.rotated(box, 25.0)["type"].alias("type"))
    assert "transform" not in turned._jdf.queryExecution().optimizedPlan().toString()


def test_clusters_by_loops(spark, monkeypatch):
    """Clumps, a chain, points at one place, alone and without a place; pairs are made for sparse cells alone."""
    rows = [(i, (i * 37 % 101) / 300 + i % 3, (i * 53 % 97) / 300) for i in range(300)] + [(1000 + i, 5 + i * 0.099, 5.0) for i in range(30)] + [(2000 + i, -3.0, -3.0) for i in range(8)] + [(3000, -9.0, 9.0), (3001, None, 1.0), (3002, math.nan, 1.0), (3003, -3.08, -3.0), (900, 5.0, 5.1)]
    points = spark.createDataFrame(rows, "id long, x double, y double")
    placed = {i: (x, y) for i, x, y in rows if x is not None and x == x}
    near = {i: [j for j, q in placed.items() if j != i and math.sqrt((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2) <= 0.1] for i, p in placed.items()}

    def labelled(core):
        label = {}
        for i in sorted(core):
            todo = [] if i in label else [i]
            while todo:
                k = todo.pop()
                if k not in label:
                    label[k] = i
                    todo += [j for j in near[k] if j in core]
        return label

    sizes = []
    pairs = stats.within_distance_pairs
    monkeypatch.setattr(stats, "within_distance_pairs", lambda a, b, *more: sizes.append(a.count()) or pairs(a, b, *more))
    label = labelled({i for i in near if len(near[i]) >= 4})
    want = {i: label.get(i, -1) for i, _, _ in rows}
    for i in near:
        if i not in label and (cores := [j for j in near[i] if j in label]):
            want[i] = label[min(cores, key=lambda j: (math.dist(placed[i], placed[j]), j))]
    assert {r.id: r.cluster for r in stats.dbscan(points, 0.1, 4).collect()} == want
    assert 0 < max(sizes) < 200
    label = labelled(set(near))
    want = {i: k if list(label.values()).count(k) >= 3 else -1 for i, k in label.items()}
    assert {r.id: r.cluster for r in stats.distance_clusters(points, 0.1, 3).collect()} == want
