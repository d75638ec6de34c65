"""Graphs as edge tables (src, dst, cost): cheapest costs and paths, areas, loads, components, spanning forests, reliability indices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.scratch import written


def undirected(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")]))


#: Rounds of relaxation between two writes of the state.
ROUNDS = 4


def shortest_costs(edges: DataFrame, origins: DataFrame, most: float | None = None) -> DataFrame:
    """origin, node, cost of every node that can be reached, at a cost of most or less; there is no limit of hops.

    Nodes whose cost improved are relaxed for a few rounds, then the state is written; it ends when none improves. Costs are
    0 at least, as otherwise that might never be. Edges without a cost lead nowhere.
    """
    out = written(edges.filter("cost is not null").select(F.col("src").alias("node"), F.col("dst").alias("_to"), F.col("cost").cast("double").alias("_more")))
    if not out.filter("_more < 0").isEmpty():
        raise ValueError("an edge costs less than 0")
    state = written(origins.select(F.col("node").alias("origin"), "node", F.lit(0.0).alias("cost")).distinct())
    last = state
    while not last.isEmpty():
        tried = state.withColumn("_old", F.col("cost"))
        for _ in range(ROUNDS):
            last = last.join(out, "node").select("origin", F.col("_to").alias("node"), (F.col("cost") + F.col("_more")).alias("cost"))
            if most is not None:
                last = last.filter(F.col("cost") <= most)
            last = last.groupBy("origin", "node").agg(F.min("cost").alias("cost"))
            tried = tried.unionByName(last, allowMissingColumns=True)
        tried = written(tried.groupBy("origin", "node").agg(F.min("cost").alias("cost"), F.min("_old").alias("_old")))
        state, last = tried.drop("_old"), tried.filter("_old is null or cost < _old").drop("_old")
    return state


def degrees(edges: DataFrame) -> DataFrame:
    return undirected(edges).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"), F.sum("cost").alias("total_cost"))


def reliability(events: DataFrame, customers: float) -> DataFrame:
    """SAIFI, SAIDI and CAIDI of outage events (impacted, hours)."""
    s, d = F.sum("impacted"), F.sum(F.col("impacted") * F.col("hours"))
    return events.agg((s / customers).alias("saifi"), (d / customers).alias("saidi"), F.when(s > 0, d / s).otherwise(F.lit(0.0)).alias("caidi"))


def components(edges: DataFrame) -> DataFrame:
    """node and component (its least node) of an undirected graph (src, dst).

    By large-star and small-star rounds: each node's larger neighbours, then its smaller ones, are hung on the least of them,
    until nothing changes. Each round's edges are written; no node's neighbours are ever collected.
    """
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    now = written(edges.filter("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    mark = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).head())
    before = None
    while (state := mark(now)) != before and state[0]:
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = written(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(hung.unionByName(least.withColumnRenamed("m", "v")).filter("u <> v").distinct())
    return nodes.join(now, nodes["node"] == now["u"], "left").select("node", F.coalesce("v", "node").alias("component"))


def shortest_tree(edges: DataFrame, origins: DataFrame, most: float | None = None) -> DataFrame:
    """origin, node, cost and prev: the least of the nodes that a cheapest path may come from, null at the origin. Edges of cost 0 lead to no prev."""
    costs = written(shortest_costs(edges, origins, most))
    step = costs.select("origin", F.col("node").alias("src"), F.col("cost").alias("_c")).join(edges.select("src", "dst", F.col("cost").alias("_e")).filter("_e > 0"), "src")
    prev = step.select("origin", F.col("dst").alias("node"), "src", (F.col("_c") + F.col("_e")).alias("cost")).join(costs, ["origin", "node", "cost"]).groupBy("origin", "node").agg(F.min("src").alias("prev"))
    return costs.join(prev, ["origin", "node"], "left")


def paths(tree: DataFrame, ends: DataFrame) -> DataFrame:
    """origin, end, node, prev, cost of each step of the paths of a tree to ends (origin, end), from the end back. A few joins between two writes."""
    tree = written(tree)
    now = ends.select("origin", "end", F.col("end").alias("node"))
    steps = tree.select("origin", "node", "prev", "cost")
    out = []
    while True:
        chunk = None
        for _ in range(ROUNDS * 2):
            here = now.join(steps, ["origin", "node"])
            chunk = here if chunk is None else chunk.unionByName(here)
            now = here.filter("prev is not null").select("origin", "end", F.col("prev").alias("node"))
        out.append(written(chunk))
        now = written(now)
        if now.isEmpty():
            break
    found = out[0]
    for x in out[1:]:
        found = found.unionByName(x)
    return found.select("origin", "end", "node", "prev", "cost")


def shortest_path(edges: DataFrame, origin, destination, most: float | None = None) -> DataFrame:
    """node, prev and cost along one cheapest path."""
    spark = edges.sparkSession
    kind = dict(edges.dtypes)["src"]
    one = spark.range(1).select(F.lit(origin).cast(kind).alias("node"))
    ends = spark.range(1).select(F.lit(origin).cast(kind).alias("origin"), F.lit(destination).cast(kind).alias("end"))
    return paths(shortest_tree(edges, one, most), ends).select("node", "prev", "cost")


def service_area(edges: DataFrame, origins: DataFrame, most: float) -> DataFrame:
    """node, origin and cost of the cheapest origin within a cost."""
    costs = shortest_costs(edges, origins, most)
    return costs.groupBy("node").agg(F.min(F.struct("cost", "origin")).alias("m")).select("node", "m.origin", "m.cost")


def allocate_demand(edges: DataFrame, supply: DataFrame, demand: DataFrame, most: float | None = None) -> DataFrame:
    """Each demand node (node, demand) with its cheapest supply node (node, supply over 0): assigned, least_cost, delivered, service_deficit, reachable."""
    reach = service_area(edges, supply.filter("supply > 0").select("node"), most if most is not None else float("inf"))
    out = demand.filter("demand > 0").join(reach, "node", "left")
    served = F.col("origin").isNotNull()
    return out.select("node", F.col("origin").alias("assigned"), F.col("cost").alias("least_cost"), "demand", F.when(served, F.col("demand")).otherwise(F.lit(0.0)).alias("delivered"), F.when(served, F.lit(0.0)).otherwise(F.lit(1.0)).alias("service_deficit"), served.alias("reachable"))


def bottlenecks(edges: DataFrame, demands: DataFrame) -> DataFrame:
    """Edges (src, dst, cost, capacity) with the load of demands (origin, end, demand) along cheapest paths, and stress, (load / capacity) squared."""
    tree = shortest_tree(edges, demands.select(F.col("origin").alias("node")).distinct())
    steps = paths(tree, demands.select("origin", "end").distinct()).filter("prev is not null")
    load = steps.join(demands.groupBy("origin", "end").agg(F.sum("demand").alias("demand")), ["origin", "end"]).groupBy(F.col("prev").alias("src"), F.col("node").alias("dst")).agg(F.sum("demand").alias("_l"))
    out = edges.join(load, ["src", "dst"], "left").withColumn("load", F.coalesce("_l", F.lit(0.0))).drop("_l")
    return out.withColumn("stress", F.when(F.col("capacity") > 0, F.pow(F.col("load") / F.col("capacity"), 2)).otherwise(F.lit(0.0)))


def impedance(cost, length=None, congestion=None, slope=None, failure_risk=None, condition=None, weights: dict[str, float] | None = None):
    """Cost of an edge by several criteria: weights base (1), length, congestion, slope, failure_risk and condition_penalty (0)."""
    w = {"base": 1.0, "length": 0.0, "congestion": 0.0, "slope": 0.0, "failure_risk": 0.0, "condition_penalty": 0.0} | (weights or {})
    zero = F.lit(0.0)
    out = cost * w["base"] + (cost if length is None else length) * w["length"]
    out = out + cost * ((congestion if congestion is not None else zero) * w["congestion"] + (slope if slope is not None else zero) * w["slope"] + (failure_risk if failure_risk is not None else zero) * w["failure_risk"])
    kept = F.lit(1.0) if condition is None else F.least(F.lit(1.0), F.greatest(zero, condition))
    return out + cost * (1 - kept) * w["condition_penalty"]


def with_traffic(edges: DataFrame, feed: DataFrame, default: float = 1.0) -> DataFrame:
    """Edges with cost * speed_factor + delay of a feed (src, dst, speed_factor, delay); cost * default where it says nothing."""
    out = edges.join(feed.select("src", "dst", "speed_factor", "delay"), ["src", "dst"], "left")
    return out.withColumn("cost", F.col("cost") * F.coalesce("speed_factor", F.lit(default)) + F.coalesce("delay", F.lit(0.0))).drop("speed_factor", "delay")


def at_hour(edges: DataFrame, hour: int, column: str = "time_costs") -> DataFrame:
    """Edges whose cost is that of an hour in a map of hours to costs, or their own."""
    return edges.withColumn("cost", F.coalesce(F.try_element_at(F.col(column), F.lit(hour)), F.col("cost")))


def preferring(edges: DataFrame, column: str, preferred: list[str], penalty: float = 1.5) -> DataFrame:
    """Edges whose cost is multiplied where their class isn't preferred."""
    return edges.withColumn("cost", F.when(F.col(column).isin(preferred), F.col("cost")).otherwise(F.col("cost") * penalty))


def without(edges: DataFrame, blocked: DataFrame) -> DataFrame:
    """Edges but those blocked (src, dst)."""
    return edges.join(blocked.select("src", "dst"), ["src", "dst"], "left_anti")


def landmark_index(edges: DataFrame, landmarks: DataFrame) -> DataFrame:
    """landmark, node and cost."""
    return shortest_costs(edges, landmarks).withColumnRenamed("origin", "landmark")


def landmark_bounds(index: DataFrame, pairs: DataFrame) -> DataFrame:
    """origin, end and the greatest difference of their costs from a landmark, 0 at least."""
    a = index.select("landmark", F.col("node").alias("origin"), F.col("cost").alias("_a"))
    b = index.select("landmark", F.col("node").alias("end"), F.col("cost").alias("_b"))
    found = pairs.join(a, "origin").join(b, ["landmark", "end"]).groupBy("origin", "end").agg(F.max(F.abs(F.col("_a") - F.col("_b"))).alias("bound"))
    return pairs.join(found, ["origin", "end"], "left").select("origin", "end", F.coalesce("bound", F.lit(0.0)).alias("bound"))


def trace(edges: DataFrame, starts: DataFrame, most: int) -> DataFrame:
    """node and depth of what can be reached along edges in at most so many steps."""
    hops = shortest_costs(edges.select("src", "dst", F.lit(1.0).alias("cost")), starts, float(most))
    return hops.groupBy("node").agg(F.min("cost").cast("long").alias("depth"))


def spanning_forest(edges: DataFrame) -> DataFrame:
    """The edges of a least spanning forest of an undirected graph, by Borůvka's rounds: each component takes its cheapest edge out (ties by src, dst)."""
    rows = written(edges.filter("src <> dst").select("src", "dst", F.col("cost").cast("double").alias("cost")))
    label = written(rows.select(F.col("src").alias("node")).unionByName(rows.select(F.col("dst").alias("node"))).distinct().withColumn("component", F.col("node")))
    chosen = None
    while True:
        out = rows.join(label.select(F.col("node").alias("src"), F.col("component").alias("a")), "src").join(label.select(F.col("node").alias("dst"), F.col("component").alias("b")), "dst").filter("a <> b")
        both = out.unionByName(out.withColumnsRenamed({"a": "b", "b": "a"}))
        best = written(both.groupBy("a").agg(F.min(F.struct("cost", "src", "dst", "b")).alias("m")).select(F.col("m.src").alias("src"), F.col("m.dst").alias("dst"), F.col("m.cost").alias("cost"), "a", F.col("m.b").alias("b")))
        if best.isEmpty():
            return chosen if chosen is not None else rows.limit(0)
        new = best.select("src", "dst", "cost").distinct()
        chosen = new if chosen is None else written(chosen.unionByName(new).distinct())
        joined = components(best.select(F.col("a").alias("src"), F.col("b").alias("dst")))
        label = written(label.join(joined, label["component"] == joined["node"], "left").select(label["node"], F.coalesce(joined["component"], label["component"]).alias("component")))


def topology(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, components, self_loops, duplicate_pairs and dead_ends (nodes of one neighbour)."""
    pairs = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    groups = components(edges)
    ends = pairs.filter("a <> b").distinct()
    near = ends.select(F.col("a").alias("n")).unionByName(ends.select(F.col("b").alias("n"))).groupBy("n").count()
    one = edges.agg(F.count("*").alias("edges"), F.count_if(F.col("src") == F.col("dst")).alias("self_loops"))
    twice = pairs.groupBy("a", "b").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_pairs"))
    return one.crossJoin(groups.agg(F.count("*").alias("nodes"), F.countDistinct("component").alias("components"))).crossJoin(twice).crossJoin(near.agg(F.count_if(F.col("count") == 1).alias("dead_ends")))


def shared_nodes(networks: dict[str, DataFrame]) -> DataFrame:
    """a, b and shared: how many nodes each two networks have in common."""
    rows = None
    for name, edges in networks.items():
        nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct().withColumn("net", F.lit(name))
        rows = nodes if rows is None else rows.unionByName(nodes)
    pairs = rows.withColumnRenamed("net", "a").join(rows.withColumnRenamed("net", "b"), "node").filter("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("shared"))


def closest_facility(edges: DataFrame, incidents: DataFrame, facilities: DataFrame, n: int = 1, most: float | None = None) -> DataFrame:
    """node (of incidents), facility, cost and rank of each incident's n cheapest facilities; costs run along edges from facilities."""
    from pyspark.sql import Window

    costs = shortest_costs(edges, facilities, most).withColumnRenamed("origin", "facility")
    order = Window.partitionBy("node").orderBy("cost", "facility")
    return costs.join(incidents.select("node"), "node", "left_semi").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def scenario_reliability(events: DataFrame, customers: float, baseline: str) -> DataFrame:
    """SAIFI, SAIDI and CAIDI of each scenario's outages and the differences to a baseline's."""
    s, d = F.sum("impacted"), F.sum(F.col("impacted") * F.col("hours"))
    rows = events.groupBy("scenario").agg((s / customers).alias("saifi"), (d / customers).alias("saidi"), F.when(s > 0, d / s).otherwise(F.lit(0.0)).alias("caidi"))
    base = F.broadcast(rows.filter(F.col("scenario") == baseline).select(*[F.col(c).alias(f"_{c}") for c in ("saifi", "saidi", "caidi")]))
    return rows.crossJoin(base).select("scenario", "saifi", "saidi", "caidi", *[(F.col(c) - F.col(f"_{c}")).alias(f"{c}_delta") for c in ("saifi", "saidi", "caidi")])
