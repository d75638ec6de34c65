"""Queries against plain loops over the whole of the small tables, so that a cut that a query and its SQL share is seen."""

import collections
import heapq
import math

import oracle
import pytest
from pyspark.sql import functions as F

from lodestone.operators import network, stats
from lodestone.plans import catalog

FOLDER = f"{oracle.DATA}/sf0.001"


def result(spark, name):
    return catalog.queries()[name](spark, FOLDER).collect()


def table(spark, name):
    return spark.read.parquet(f"{FOLDER}/{name}.parquet")


def test_overlay_route_events(spark):
    routes = collections.defaultdict(list)
    for r in table(spark, "lineitem").select("l_partkey", "l_suppkey", "l_quantity").collect():
        lo = r.l_suppkey % 20
        routes[r.l_partkey % 50].append((lo, lo + r.l_quantity / 10))
    pairs, overlap = 0, 0.0
    for rows in routes.values():
        for lo, hi in rows:
            for lo2, hi2 in rows:
                if lo < hi2 and lo2 < hi:
                    pairs += 1
                    overlap += min(hi, hi2) - max(lo, lo2)
    [got] = result(spark, "overlay_route_events")
    assert got.pairs == pairs
    assert got.overlap == pytest.approx(overlap, abs=0.01)


def test_temporal_join_nearest(spark):
    users = collections.defaultdict(list)
    for r in table(spark, "events").selectExpr("event_id", "user_id", "unix_micros(cast(ts as timestamp)) AS at").collect():
        users[r.user_id].append((r.at, r.event_id))
    want = {}
    for rows in users.values():
        for at, i in rows:
            near = [(abs(at - at2), j) for at2, j in rows if i % 2 == 0 and j % 2 == 1 and abs(at - at2) <= 21600 * 10**6]
            if near:
                want[i] = min(near)[1]
    got = result(spark, "temporal_join_nearest")
    assert {r.event_id: r.event_id_right for r in got} == want
    assert len(got) == len(want)


def test_reliability_indices(spark):
    rows = [(r.user_id + 1.0, abs(r.value) / 10) for r in table(spark, "events").collect()]
    impacted, hours = sum(i for i, _ in rows), sum(i * h for i, h in rows)
    [got] = result(spark, "reliability_indices")
    assert tuple(got) == (pytest.approx(impacted / 1000), pytest.approx(hours / 1000, abs=1e-4), pytest.approx(hours / impacted, abs=1e-6))


def test_joins_take_every_row(spark):
    orders, customers = table(spark, "orders").collect(), table(spark, "customer").collect()
    some = {r.o_custkey for r in orders}
    want = [(r.o_custkey, r.o_orderkey, "both") for r in orders] + [(r.c_custkey, None, "left_only") for r in customers if r.c_custkey not in some]
    got = result(spark, "merge_left_indicator")
    assert sorted(map(repr, ((r.c_custkey, r.o_orderkey, r._merge) for r in got))) == sorted(map(repr, want))
    # A quarter of the customers meet the null keys of nations, those of BUILDING the others.
    want = [(c.c_custkey, n) for c in customers for n in range(25) if (n % 6 == 0 if c.c_custkey % 4 == 0 else n % 6 and c.c_mktsegment == "BUILDING")]
    assert sorted((r.c_custkey, r.n_nationkey) for r in result(spark, "join_nullsafe")) == sorted(want)


def test_explode_parts(spark):
    want = [(r.vec_id, i, float(v)) for r in table(spark, "embeddings").collect() for i, v in enumerate(r.embedding)]
    assert sorted(tuple(r) for r in result(spark, "explode_parts")) == sorted(want)


def dijkstra(edges, origin):
    out, cost, queue = collections.defaultdict(list), {}, [(0.0, origin)]
    for a, b, c in edges:
        out[a].append((b, c))
    while queue:
        c, node = heapq.heappop(queue)
        if node not in cost:
            cost[node] = c
            for b, more in out[node]:
                heapq.heappush(queue, (c + more, b))
    return cost


def test_od_cost_matrix(spark):
    edges = [tuple(r) for r in catalog.Tables(spark, FOLDER).grid().collect()]
    got = result(spark, "od_cost_matrix")
    assert len(got) == 144
    assert {r.node: r.cost for r in got} == dijkstra(edges, 0)


def test_shortest_costs_without_a_limit_of_hops(spark):
    # A chain of 30 hops is cheaper than the direct edge; it has a cycle of no cost, and a part that can't be reached.
    edges = [(i, i + 1, 1.0) for i in range(30)] + [(0, 30, 31.0), (5, 6, 0.5), (6, 5, 0.0), (7, 7, 0.0), (40, 41, 1.0)]
    df = spark.createDataFrame(edges, "src long, dst long, cost double")
    origins = spark.createDataFrame([(0,), (6,), (6,)], "node long")
    want = {(o, n): c for o in (0, 6) for n, c in dijkstra(edges, o).items()}
    assert {(r.origin, r.node): r.cost for r in network.shortest_costs(df, origins).collect()} == want
    near = network.shortest_costs(df, origins, 10.0).collect()
    assert {(r.origin, r.node): r.cost for r in near} == {k: c for k, c in want.items() if c <= 10}
    with pytest.raises(ValueError):
        network.shortest_costs(df.withColumn("cost", -F.col("cost")), origins)


def test_idw_keeps_points_out_of_reach(spark):
    known = spark.createDataFrame([(1, 0.0, 0.0, 2.0), (2, 1.0, 0.0, 6.0)], "id long, x double, y double, v double")
    query = spark.createDataFrame([(10, 0.0, 0.0, 0.0), (11, 0.5, 0.0, 0.0), (12, 3.0, 0.0, 0.0)], "id long, x double, y double, v double")
    values = lambda rows: {r.id: r.value for r in rows.collect()}
    assert values(stats.idw(known, query, 0.6)) == {10: 2.0, 11: 4.0, 12: None}
    assert values(stats.idw(known, query)) == {10: 2.0, 11: 4.0, 12: pytest.approx((2 / 9 + 6 / 4) / (1 / 9 + 1 / 4))}
    assert values(stats.idw(known.limit(0), query)) == {10: None, 11: None, 12: None}
    t = catalog.Tables(spark, FOLDER)
    d, f = t.demand().collect(), t.facilities().collect()
    alone = {a.id for a in d if all(math.dist((a.x, a.y), (b.x, b.y)) > 0.1 for b in f)}
    got = values(stats.idw(t.facilities(), t.demand(), 0.1))
    assert alone and len(got) == len(d)
    assert {i for i, v in got.items() if v is None} == alone


def test_huff_model_takes_every_facility(spark):
    t = catalog.Tables(spark, FOLDER)
    f, want = t.facilities().collect(), {}
    for a in t.demand().collect():
        pull = {b.id: (b.v + 1) / max(math.dist((a.x, a.y), (b.x, b.y)), 1e-9) ** 2 for b in f}
        want |= {(a.id, i): p / sum(pull.values()) for i, p in pull.items()}
    got = result(spark, "huff_model")
    assert len(got) == len(want)
    assert all(abs(r.probability - want[r.id, r.id_s]) < 2e-6 for r in got)


def test_interactions_of_all_points(spark):
    points = catalog.Tables(spark, FOLDER).points().collect()
    apart = {(a.id, b.id): (a.v, b.v, math.dist((a.x, a.y), (b.x, b.y))) for a in points for b in points if a.id != b.id}
    got = result(spark, "interaction_table")
    assert len(got) == len(apart)
    for r in got:
        va, vb, d = apart[r.origin, r.destination]
        assert abs(r.interaction - va * vb / (1 + d) ** 2) < 2e-6
    want = collections.defaultdict(float)
    for (i, _), (_, vb, d) in apart.items():
        want[i] += vb / (1 + d / 0.1) ** 2
    got = result(spark, "neighborhood_pressure")
    assert {r.id: r.pressure for r in got} == pytest.approx(dict(want), abs=2e-6)
