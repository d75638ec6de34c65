"""Queries on frames and tables: projection, predicates, aggregation, ordered functions, shapes, sets, text and time."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.frame import Table
from lodestone.operators import expression
from lodestone.plans.catalog import query, r6


def _events(t, **kwargs) -> Table:
    """Events by id; value is null in every seventh row."""
    e = t.events.select("event_id", "ts", "user_id", "event_type", F.expr("CASE WHEN event_id % 7 <> 0 THEN value END").alias("value"))
    return Table(e, order="event_id", **kwargs)


_E = "e AS (SELECT event_id, ts, user_id, event_type, CASE WHEN event_id % 7 <> 0 THEN value END AS value FROM events)"
_O = "OVER (ORDER BY event_id)"


@query(f"WITH {_E} SELECT event_id, value FROM e WHERE event_type = 'click' AND value IS NULL")
def frame_where(t):
    return _events(t).where(event_type="click", value=None).select_columns(["event_id", "value"]).df


@query(f"WITH {_E} SELECT event_id FROM e WHERE event_id % 3 = 0 AND value > 10")
def frame_where_predicate(t):
    return _events(t).where(F.col("value") > 10).where(lambda r: r["event_id"] % 3 == 0).select_columns(["event_id"]).df


@query(f"WITH {_E} SELECT event_id, value * 2 + user_id AS result FROM e")
def frame_eval(t):
    return _events(t).eval("value * 2 + user_id").select_columns(["event_id", "result"]).df


@query(f"WITH {_E} SELECT event_id, CASE WHEN user_id % 2 = 1 THEN event_type END AS event_type, CASE WHEN user_id % 2 = 1 THEN value END AS value FROM e WHERE user_id % 2 = 1 UNION ALL SELECT NULL, NULL, NULL FROM e WHERE user_id % 2 = 0")
def frame_mask(t):
    return _events(t).mask(F.col("user_id") % 2 == 0).select_columns(["event_id", "event_type", "value"]).df


@query(f"WITH {_E} SELECT event_id, CASE WHEN value IS NOT NULL THEN least(greatest(value, 5), 50) END AS value, event_type IN ('click', 'view') AS member, value >= 5 AND value < 50 AS between_left FROM e")
def frame_clip_isin_between(t):
    e = _events(t)
    return e.with_column("member", e.isin("event_type", ["click", "view"])).with_column("between_left", e.between("value", 5, 50, "left")).clip_values("value", 5.0, 50.0).select_columns(["event_id", "value", "member", "between_left"]).df


@query(f"WITH {_E} SELECT count(*) FILTER (WHERE value IS NULL) AS nulls, count(*) FILTER (WHERE value IS NOT NULL) AS others FROM e")
def frame_isna_notna(t):
    e = _events(t)
    return e.isna().df.agg(F.count_if("value").alias("nulls")).join(e.notna().df.agg(F.count_if("value").alias("others")))


@query(f"WITH {_E} SELECT event_type AS kind, event_id, value + 1 AS more, (value + 1) * 2 AS twice FROM e")
def frame_assign_rename_reorder(t):
    e = _events(t).assign(more=F.col("value") + 1, twice=lambda f: F.col("more") * 2).rename_columns({"event_type": "kind"})
    return e.drop_columns(["ts", "user_id", "value"]).reorder_columns(["kind", "event_id"]).df


@query("SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, CAST(ts AS DATE) AS ts, CASE event_type WHEN 'click' THEN 'c' WHEN 'view' THEN 'v' ELSE event_type END AS event_type, upper(event_type) AS loud, value * 10 AS value FROM events")
def frame_astype_replace_map(t):
    e = Table(t.events.select("event_id", "user_id", "ts", "event_type", "value"))
    e = e.astype("user_id", "str").astype("ts", "date").map_column("event_type", F.upper, new_column="loud").replace("event_type", {"click": "c", "view": "v"})
    return e.applymap(lambda c: c * 10, ["value"]).df


@query("SELECT o_orderkey, o_totalprice * 0.1 AS tax FROM orders")
def frame_apply_rows(t):
    return Table(t.orders.select("o_orderkey", "o_totalprice")).pipe(lambda f: f.apply_rows(lambda r: {"o_orderkey": r["o_orderkey"], "tax": r["o_totalprice"] * 0.1}, "o_orderkey long, tax double")).df


@query(f"WITH {_E} SELECT event_id, coalesce(value, -1.0) AS filled, last_value(value IGNORE NULLS) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS forward, first_value(value IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS backward FROM e")
def frame_fillna(t):
    e = _events(t).select_columns(["event_id", "value"])
    f, b = e.fillna(method="ffill", column="value"), e.fillna(method="bfill", column="value")
    out = e.fillna(-1.0, "value").df.withColumnRenamed("value", "filled").join(f.df.withColumnRenamed("value", "forward"), "event_id")
    return out.join(b.df.withColumnRenamed("value", "backward"), "event_id")


@query(f"WITH {_E} SELECT event_id FROM e WHERE value IS NOT NULL")
def frame_dropna(t):
    return _events(t).dropna(["value"]).select_columns(["event_id"]).df


@query("SELECT DISTINCT event_type FROM events")
def frame_unique(t):
    return _events(t).unique("event_type").df


@query("SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS \"index\" FROM events")
def frame_reset_index(t):
    return _events(t).select_columns(["event_id"]).reset_index().df


@query("SELECT event_id, event_type FROM events WHERE event_id IN (3, 5, 8)")
def frame_loc(t):
    return _events(t).set_index("event_id").loc([3, 5, 8]).select_columns(["event_id", "event_type"]).df


_AB = "a AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 > 0 THEN c_acctbal END AS v FROM customer), b AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 > 0 THEN -c_acctbal END AS v FROM customer)"


def _ab(t):
    c = t.customer
    return tuple(Table(c.select(F.col("c_custkey").alias("k"), F.expr(v).alias("v")), order="k") for v in ("CASE WHEN c_custkey % 3 > 0 THEN c_acctbal END", "CASE WHEN c_custkey % 2 > 0 THEN -c_acctbal END"))


@query(f"WITH {_AB} SELECT k, coalesce(a.v, b.v) AS first, b.v AS over, coalesce(a.v, b.v) AS fill FROM a JOIN b USING (k)")
def frame_combine_update(t):
    a, b = _ab(t)
    out = a.combine_first(b).df.withColumnRenamed("v", "first").join(a.update(b).df.withColumnRenamed("v", "over"), "k")
    return out.join(a.update(b, overwrite=False).df.withColumnRenamed("v", "fill"), "k")


@query(f"WITH {_AB} SELECT row_number() OVER (ORDER BY k) - 1 AS row, 'v' AS \"column\" FROM a JOIN b USING (k) QUALIFY a.v IS DISTINCT FROM b.v")
def frame_compare(t):
    a, b = _ab(t)
    return a.compare(b, ["v"]).df.select("row", "column")


# Sorting, picking, sets.


@query("SELECT o_orderkey, o_totalprice, o_custkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 30")
def frame_nlargest(t):
    return Table(t.orders.select("o_orderkey", "o_totalprice", "o_custkey"), order="o_orderkey").nlargest(30, "o_totalprice").df


@query("(SELECT 'head' AS side, o_orderkey FROM orders ORDER BY o_orderkey LIMIT 7) UNION ALL (SELECT 'tail', o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 7) UNION ALL (SELECT 'small', o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 7)")
def frame_head_tail(t):
    o = Table(t.orders.select("o_orderkey", "o_totalprice"), order="o_orderkey")
    named = lambda f, side: f.df.select(F.lit(side).alias("side"), "o_orderkey")
    return named(o.head(7), "head").unionByName(named(o.tail(7), "tail")).unionByName(named(o.nsmallest(7, "o_totalprice"), "small"))


@query("SELECT min(o_orderkey) AS o_orderkey, o_custkey, 'first' AS keep FROM orders GROUP BY o_custkey UNION ALL SELECT max(o_orderkey), o_custkey, 'last' FROM orders GROUP BY o_custkey")
def frame_drop_duplicates(t):
    o = Table(t.orders.select("o_orderkey", "o_custkey"), order="o_orderkey")
    return o.drop_duplicates(["o_custkey"]).df.withColumn("keep", F.lit("first")).unionByName(o.drop_duplicates(["o_custkey"], "last").df.withColumn("keep", F.lit("last")))


@query("SELECT c_custkey AS k, c_name AS name, NULL AS n FROM customer UNION ALL SELECT s_suppkey, NULL, s_nationkey FROM supplier")
def frame_concat(t):
    a, b = Table(t.customer.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))), Table(t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n")))
    return a.concat([b]).df


@query("WITH r AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS row, c_nationkey, c_mktsegment FROM customer) SELECT c_nationkey, c_mktsegment, count(*) AS n, min(row) AS first, max(row) AS last FROM r GROUP BY 1, 2 HAVING count(*) > 1")
def frame_find_identical(t):
    found = Table(t.customer.select("c_custkey", "c_nationkey", "c_mktsegment"), order="c_custkey").find_identical(["c_nationkey", "c_mktsegment"]).df
    return found.select("c_nationkey", "c_mktsegment", F.size("rows").cast("long").alias("n"), F.element_at("rows", 1).alias("first"), F.element_at("rows", -1).alias("last"))


# Aggregation.


@query(f"WITH {_E} SELECT user_id, count(*) AS row_count, sum(value) AS value_sum, median(value) AS value_median, count(DISTINCT event_type) AS event_type_unique_count FROM e GROUP BY 1")
def frame_groupby_agg(t):
    return _events(t).groupby("user_id").agg({"value": ["sum", "median"], "event_type": "unique_count"}).df


@query(f"WITH {_E} SELECT avg(value) AS value_mean, min(value) AS value_min, max(value) AS value_max, count(value) AS value_count FROM e")
def frame_agg(t):
    return _events(t).agg({"value": ["mean", "min", "max", "count"]}).df


@query(f"WITH {_E}, m AS (SELECT *, value - avg(value) OVER (PARTITION BY user_id) AS centred, max(value) OVER (PARTITION BY user_id) AS top FROM e) SELECT event_id, centred FROM m WHERE top > 50")
def frame_group_transform_filter(t):
    e = _events(t).groupby("user_id").transform("value", lambda c, w: c - F.avg(c).over(w), new_column="centred")
    return e.groupby("user_id").filter(lambda w: F.max("value").over(w) > 50).select_columns(["event_id", "centred"]).df


@query("SELECT user_id, event_id, 'first' AS at FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1 UNION ALL SELECT user_id, event_id, 'last' FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1 UNION ALL SELECT user_id, event_id, 'second' FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 2")
def frame_group_first_last_nth(t):
    g = Table(t.events.select("user_id", "event_id"), order="event_id").groupby("user_id")
    named = lambda f, at: f.df.withColumn("at", F.lit(at))
    return named(g.first(), "first").unionByName(named(g.last(), "last")).unionByName(named(g.nth(1), "second"))


@query("WITH f AS (SELECT event_type, dense_rank() OVER (ORDER BY min(event_id)) - 1 AS ngroup FROM events GROUP BY 1) SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS cumcount, ngroup FROM events JOIN f USING (event_type)")
def frame_cumcount_ngroup(t):
    e = Table(t.events.select("event_id", "event_type"), order="event_id")
    return e.groupby("event_type").cumcount().groupby("event_type").ngroup().select_columns(["event_id", "cumcount", "ngroup"]).df


@query("SELECT user_id, max(value) - min(value) AS spread FROM events GROUP BY 1")
def frame_group_apply(t):
    def spread(pdf):
        import pandas as pd

        return pd.DataFrame({"user_id": [pdf["user_id"].iloc[0]], "spread": [pdf["value"].max() - pdf["value"].min()]})

    return Table(t.events.select("user_id", "value")).groupby("user_id").apply(spread, "user_id long, spread double").df


@query("SELECT o_orderpriority, count(*) AS count, count(*) / sum(count(*)) OVER () AS share FROM orders GROUP BY 1")
def frame_value_counts(t):
    return Table(t.orders).value_counts("o_orderpriority").df


_D = "SELECT '{0}' AS \"column\", count(*) AS row_count, count({0}) AS non_null_count, count(*) - count({0}) AS null_count, count(DISTINCT {0}) AS unique_count, sum({0}) AS sum, avg({0}) AS mean, median({0}) AS median, min({0})::DOUBLE AS min, max({0})::DOUBLE AS max FROM e"


@query(f"WITH {_E} {_D.format('value')} UNION ALL {_D.format('user_id')}")
def frame_describe(t):
    return _events(t).describe(["value", "user_id"]).df


@query("SELECT c_nationkey, avg(c_acctbal) FILTER (WHERE c_mktsegment = 'BUILDING') AS \"BUILDING\", avg(c_acctbal) FILTER (WHERE c_mktsegment = 'MACHINERY') AS \"MACHINERY\" FROM customer GROUP BY 1")
def frame_pivot(t):
    return Table(t.customer).pivot("c_nationkey", "c_mktsegment", "c_acctbal", "mean", ["BUILDING", "MACHINERY"]).df


@query("SELECT c_nationkey, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS \"BUILDING\", count(*) FILTER (WHERE c_mktsegment = 'MACHINERY') AS \"MACHINERY\" FROM customer GROUP BY 1")
def frame_crosstab(t):
    return Table(t.customer).crosstab("c_nationkey", "c_mktsegment", names=["BUILDING", "MACHINERY"]).df


@query(f"WITH {_E} SELECT 'event_type' AS \"column\", count(DISTINCT event_type) AS nunique FROM e UNION ALL SELECT 'user_id', count(DISTINCT user_id) FROM e")
def frame_nunique(t):
    return _events(t).nunique(["event_type", "user_id"]).df


@query("WITH c AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) SELECT c_nationkey FROM c WHERE n = (SELECT max(n) FROM c)")
def frame_mode(t):
    return Table(t.customer).mode("c_nationkey").df


@query(f"WITH {_E}, m AS (SELECT avg(value) AS mu, stddev_pop(value) AS sd, count(value) AS n FROM e) SELECT stddev_samp(value) / sqrt(count(value)) AS sem, avg(power((value - mu) / sd, 3)) AS skew, avg(power((value - mu) / sd, 4)) - 3 AS kurtosis FROM e, m")
def frame_moments(t):
    return _events(t).moments("value").df


@query(f"WITH {_E}, r AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS i, value FROM e) SELECT arg_min(i, value) AS idxmin, arg_max(i, value) AS idxmax FROM r")
def frame_idxmin_idxmax(t):
    e = _events(t)
    return t.spark.createDataFrame([(e.idxmin("value"), e.idxmax("value"))], "idxmin long, idxmax long")


_M = "m AS (SELECT avg(l_quantity) AS a, stddev_pop(l_quantity) AS s, avg(l_extendedprice) AS b, stddev_pop(l_extendedprice) AS r FROM lineitem)"


@query("SELECT 'l_quantity' AS a, 'l_quantity' AS b, corr(l_quantity, l_quantity) AS corr, covar_samp(l_quantity, l_quantity) AS cov FROM lineitem UNION ALL SELECT 'l_quantity', 'l_extendedprice', corr(l_quantity, l_extendedprice), covar_samp(l_quantity, l_extendedprice) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_quantity', corr(l_quantity, l_extendedprice), covar_samp(l_quantity, l_extendedprice) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_extendedprice', 1.0, covar_samp(l_extendedprice, l_extendedprice) FROM lineitem")
def frame_corr_cov(t):
    l = Table(t.lineitem.select("l_quantity", "l_extendedprice"))  # noqa: E741
    return l.corr().df.join(l.cov().df, ["a", "b"])


@query(f"WITH {_E} SELECT 'event_id' AS \"column\", count(event_id) AS non_null FROM e UNION ALL SELECT 'value', count(value) FROM e")
def frame_info(t):
    return _events(t).select_columns(["event_id", "value"]).info().df.select("column", "non_null")


@query(f"WITH {_E} SELECT 'event_id' AS \"column\", count(*) AS rows, count(*) - count(event_id) AS nulls, count(DISTINCT event_id) AS distinct FROM e UNION ALL SELECT 'value', count(*), count(*) - count(value), count(DISTINCT value) FROM e")
def frame_summary(t):
    return _events(t).select_columns(["event_id", "value"]).summary().df


@query("SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS period, sum(o_totalprice) AS o_totalprice_sum, count(o_orderkey) AS o_orderkey_count FROM orders GROUP BY 1")
def frame_resample(t):
    return Table(t.orders.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))).resample("month", "o_orderdate", {"o_totalprice": "sum", "o_orderkey": "count"}).df.withColumn("period", F.col("period").cast("timestamp_ntz"))


# Ordered functions over whole tables.


@query(f"WITH {_E} SELECT event_id, CASE WHEN value IS NOT NULL THEN sum(value) {_O} END AS value_cumsum, max(value) {_O} AS value_cummax, min(value) {_O} AS value_cummin FROM e")
def frame_cumulative(t):
    e = _events(t).select_columns(["event_id", "value"])
    return e.cumsum("value").cummax("value").cummin("value").drop_columns(["value"]).df


@query("WITH f AS (SELECT event_id, 1 + (event_id % 7 - 3) / 1000.0::DOUBLE AS g FROM events) SELECT event_id, round(exp(sum(ln(g)) OVER (ORDER BY event_id)), 6) AS g_cumprod FROM f")
def frame_cumprod(t):
    e = Table(t.events.select("event_id", (1 + (F.col("event_id") % 7 - 3) / F.lit(1000.0)).alias("g")), order="event_id")
    return e.cumprod("g").df.select("event_id", r6("g_cumprod").alias("g_cumprod"))


@query(f"WITH {_E} SELECT event_id, value - lag(value, 2) {_O} AS value_diff, CASE WHEN lag(value) {_O} <> 0 THEN (value - lag(value) {_O}) / abs(lag(value) {_O}) END AS value_pct_change FROM e")
def frame_diff_pct_change(t):
    return _events(t).select_columns(["event_id", "value"]).diff("value", 2).pct_change("value").drop_columns(["value"]).df


_R = "OVER (ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"


@query(f"WITH {_E} SELECT event_id, CASE WHEN row_number() {_O} >= 5 THEN avg(value) {_R} END AS value_rolling_mean, CASE WHEN row_number() {_O} >= 5 THEN max(value) {_R} END AS value_rolling_max, CASE WHEN row_number() {_O} >= 5 THEN stddev_pop(value) {_R} END AS value_rolling_std FROM e")
def frame_rolling(t):
    return _events(t).select_columns(["event_id", "value"]).rolling("value", 5).rolling("value", 5, "max").rolling("value", 5, "std").drop_columns(["value"]).df


@query(f"WITH {_E} SELECT event_id, avg(value) {_O} AS value_expanding_mean, stddev_pop(value) {_O} AS value_expanding_std, sum(coalesce(value, 0)) {_O} AS total FROM e")
def frame_expanding(t):
    e = _events(t).select_columns(["event_id", "value"])
    out = e.expanding("value").expanding("value", "std").expanding("value", "max").df
    return out.join(e.fillna(0.0, "value").cumsum("value").df.select("event_id", F.col("value_cumsum").alias("total")), "event_id").drop("value", "value_expanding_max")


_T = "(count(*) OVER (PARTITION BY c_nationkey))"


@query(f"SELECT c_custkey, rank() OVER (ORDER BY c_nationkey) + ({_T} - 1) / 2.0::DOUBLE AS average, (rank() OVER (ORDER BY c_nationkey))::DOUBLE AS least, (rank() OVER (ORDER BY c_nationkey DESC) + {_T} - 1)::DOUBLE AS most, (dense_rank() OVER (ORDER BY c_nationkey))::DOUBLE AS dense FROM customer")
def frame_rank(t):
    c = Table(t.customer.select("c_custkey", "c_nationkey"))
    out = c.rank("c_nationkey").rename_columns({"rank": "average"}).rank("c_nationkey", method="min").rename_columns({"rank": "least"})
    return out.rank("c_nationkey", False, "max").rename_columns({"rank": "most"}).rank("c_nationkey", method="true_dense").rename_columns({"rank": "dense"}).drop_columns(["c_nationkey"]).df


# Shapes.


@query("SELECT p_partkey, 'p_size' AS variable, p_size::DOUBLE AS value FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part")
def frame_melt(t):
    return Table(t.part.select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")).melt(["p_partkey"]).df


@query("SELECT p_partkey, 'a' AS j, p_size::DOUBLE AS v FROM part UNION ALL SELECT p_partkey, 'b', p_retailprice FROM part")
def frame_stack_wide_to_long(t):
    p = Table(t.part.select("p_partkey", F.col("p_size").cast("double").alias("v_a"), F.col("p_retailprice").alias("v_b")))
    stacked = p.stack(["v_a", "v_b"]).df.select("p_partkey", F.substring("variable", 3, 1).alias("j"), F.col("value").alias("v"))
    return stacked.intersectAll(p.wide_to_long(["v"], "p_partkey", "j").df)


@query("SELECT c_nationkey, min(c_name) FILTER (WHERE c_mktsegment = 'BUILDING') AS \"BUILDING\" FROM customer GROUP BY 1")
def frame_unstack(t):
    return Table(t.customer).unstack("c_nationkey", "c_mktsegment", "c_name", "min", ["BUILDING"]).df


@query("SELECT 'n_name' AS field, max(n_name) FILTER (WHERE n_nationkey = 1) AS \"1\", max(n_name) FILTER (WHERE n_nationkey = 2) AS \"2\" FROM nation UNION ALL SELECT 'n_regionkey', max(n_regionkey::VARCHAR) FILTER (WHERE n_nationkey = 1), max(n_regionkey::VARCHAR) FILTER (WHERE n_nationkey = 2) FROM nation")
def frame_transpose(t):
    return Table(t.nation).transpose("n_nationkey", [1, 2]).df


# Joins, text and time.


@query("SELECT o_orderkey, o.o_custkey AS c_custkey, c_name FROM orders o JOIN customer c ON o_custkey = c_custkey")
def frame_merge_validated(t):
    o = Table(t.orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey")))
    return o.merge(Table(t.customer.select("c_custkey", "c_name")), "c_custkey", validate="many_to_one").df


@query("SELECT a.n_nationkey, a.n_name, b.n_name AS n_name_right FROM nation a LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 2) b ON a.n_nationkey = b.n_nationkey")
def table_join_left(t):
    n = Table(t.nation.select("n_nationkey", "n_name"))
    return n.join(Table(t.nation.filter("n_regionkey < 2").select("n_nationkey", "n_name")), "n_nationkey", "left").df


@query("SELECT n_nationkey, lower(n_name) AS low, upper(n_name) AS up, trim('  ' || n_name || ' ') AS stripped, contains(lower(n_name), 'an') AS has FROM nation")
def frame_text(t):
    n = Table(t.nation.select("n_nationkey", "n_name", F.concat(F.lit("  "), "n_name", F.lit(" ")).alias("wide")))
    n = n.lower("n_name", "low").upper("n_name", "up").strip("wide", "stripped")
    return n.with_column("has", n.contains("n_name", "AN", case=False)).select_columns(["n_nationkey", "low", "up", "stripped", "has"]).df


@query("SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, (isodow(o_orderdate) - 1)::INTEGER AS w FROM orders")
def frame_time(t):
    o = Table(t.orders.select("o_orderkey", "o_orderdate"))
    return o.year("o_orderdate", "y").month("o_orderdate", "m").day("o_orderdate", "d").weekday("o_orderdate", "w").drop_columns(["o_orderdate"]).df


@query("SELECT count(*) AS n FROM (SELECT * FROM customer WHERE c_mktsegment LIKE 'B%' AND c_nationkey BETWEEN 3 AND 12)")
def frame_predicates(t):
    names = t.customer.columns
    return t.customer.filter(expression.compile_expression("c_nationkey >= 3 and c_nationkey <= 12", names)).filter(F.col("c_mktsegment").like("B%")).agg(F.count("*").alias("n"))
