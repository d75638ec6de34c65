"""Hand-computed cases."""

import math

import pytest
from pyspark.sql import functions as F

from lodestone.functions import equations as eq
from lodestone.functions import geometry as geo
from lodestone.operators import expression, spatial, stats, table
from lodestone.sources import files
from lodestone.streaming import events


def one(spark, column):
    return spark.range(1).select(column.alias("v")).head()[0]


def test_equations(spark):
    assert math.isclose(one(spark, eq.power_decay(F.lit(1.0))), 0.25)
    assert math.isclose(one(spark, eq.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0))), 6371.0088 * math.pi / 2)
    assert one(spark, eq.area_similarity(F.lit(0.0), F.lit(0.0), F.lit(0.0))) == 1.0
    assert math.isclose(one(spark, eq.bearing(F.lit(0.0), F.lit(0.0), F.lit(-1.0), F.lit(0.0))), 270.0)


def test_geometry(spark):
    square = geo.rectangle(*[F.lit(float(x)) for x in (0, 0, 2, 2)])
    assert one(spark, geo.area(square)) == 4.0
    assert one(spark, geo.length(square)) == 8.0
    inside = lambda x, y: one(spark, geo.contains_point(square, F.lit(x), F.lit(y)))
    assert inside(1.0, 1.0) and inside(2.0, 1.0) and not inside(3.0, 1.0)
    assert one(spark, geo.to_wkt(geo.from_wkt(F.lit("LINESTRING (0 1, 2 3)")))) == "LINESTRING (0.0 1.0, 2.0 3.0)"
    assert one(spark, geo.from_wkt(F.lit("CIRCLE (1)"))) is None


def test_nearest_join_agrees_with_all_pairs(spark):
    p = spark.range(300).select("id", ((F.col("id") * 37) % 101 / 101.0).alias("x"), ((F.col("id") * 53) % 97 / 97.0).alias("y"), F.lit(1.0).alias("v"))
    got = {(r.id, r.rank): r.distance for r in spatial.nearest_join(p, p, 3, exclude_self=True).collect()}
    rows = p.collect()
    for r in rows[::17]:
        best = sorted(math.dist((r.x, r.y), (q.x, q.y)) for q in rows if q.id != r.id)[:3]
        assert [round(got[r.id, k + 1], 9) for k in range(3)] == [round(b, 9) for b in best]


def test_joins_of_empty_tables(spark):
    none = spark.createDataFrame([], "id long, x double, y double, v double")
    some = spark.createDataFrame([(1, 0.0, 0.0, 1.0)], "id long, x double, y double, v double")
    assert spatial.proximity_join(some, none, 1.0, "left").count() == 1
    assert spatial.nearest_join(some, none, 1).count() == 0
    assert spatial.nearest_join(none, some, 1).count() == 0
    assert stats.spatial_lag(some, stats.weights(some, 1.0)).head().lag == 0.0


@pytest.mark.parametrize("text", ["__import__('os')", "a.b", "[x for x in a]", "lambda: 1", "a if", "nothing + 1", "open('f')"])
def test_refused_expressions(text):
    with pytest.raises(ValueError):
        expression.compile_expression(text, ["a"])


def test_where(spark):
    df = spark.createDataFrame([(1, "Abc"), (None, "x%"), (3, None)], "n int, s string")
    count = lambda w: df.filter(expression.compile_where(w, df.columns)).count()
    assert [count(w) for w in ("n = 1", "s LIKE 'a%'", "n IS NULL", "s IS NOT NULL", "n BETWEEN 0 AND 2", "n IN (1, 3)")] == [1, 1, 1, 2, 2, 2]


def test_null_keys_match(spark):
    a = spark.createDataFrame([(None, 1), ("k", 2)], "k string, a int")
    b = spark.createDataFrame([(None, 3)], "k string, a int")
    rows = table.merge(a, b, ["k"], "left", indicator=True).collect()
    assert sorted((r.k or "", r.a_left, r.a_right, r._merge) for r in rows) == [("", 1, 3, "both"), ("k", 2, None, "left_only")]


def test_geojson_round_trip(spark, tmp_path):
    g = geo.rectangle(*[F.lit(float(x)) for x in (0, 0, 1, 1)])
    rows = spark.range(2).select("id", g.alias("geom")).unionByName(spark.range(2, 3).select("id", geo.point(F.lit(1), F.lit(2)).alias("geom")))
    files.write_geojsonl(rows, str(tmp_path / "f"))
    back = files.read_geojsonl(spark, str(tmp_path / "f"), "id long")
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"2024-01-01 00:{i:02d}:00", "ab"[i % 2]) for i in range(40)], "id long, t string, k string").withColumn("t", F.to_timestamp("t"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = events.event_stream(spark, str(tmp_path / "in"), rows.schema)
    counts = events.windowed_counts(stream, "t", "10 minutes", "1 hour", ["k"])
    q = counts.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    batch = rows.groupBy(F.window("t", "10 minutes").alias("w"), "k").count().select("w.start", "w.end", "k", "count")
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, batch.collect()))
