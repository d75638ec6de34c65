"""Readers and writers: round trips, order of limit and filter, schemas."""

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.functions import geometry as geo
from lodestone.sources import data


def shapes(spark):
    rows = [(1, "POINT (1 2)"), (2, "LINESTRING (0 0, 3 4)"), (3, "POLYGON ((0 0, 2 0, 2 1, 0 1, 0 0))")]
    return spark.createDataFrame(rows, "id long, wkt string").select("id", geo.from_wkt(F.col("wkt")).alias("geometry"))


def measures(df, key="id"):
    return sorted((int(r[0]), r[1], round(r[2], 9), round(r[3], 9)) for r in df.select(key, geo.kind(F.col("geometry")), geo.length(F.col("geometry")), geo.area(F.col("geometry"))).collect())


WANT = [(1, "Point", 0.0, 0.0), (2, "LineString", 5.0, 0.0), (3, "Polygon", 6.0, 2.0)]


def test_geojson_lines(spark, tmp_path):
    data.write_geojsonl(shapes(spark), f"{tmp_path}/a.geojsonl")
    back = data.read_data(spark, f"{tmp_path}/a.geojsonl").withColumn("id", F.col("properties")["id"])
    assert measures(back) == WANT
    assert data.feature_count(spark, f"{tmp_path}/a.geojsonl") == 3


def test_geojson_collection_and_merge(spark, tmp_path):
    whole = data.feature_collection(shapes(spark))
    assert whole["count"] == 3 and whole["bbox"] == [0.0, 0.0, 3.0, 4.0]
    (tmp_path / "c.geojson").write_text(json.dumps(whole, indent=1))
    back = data.read_geojson(spark, f"{tmp_path}/c.geojson").withColumn("id", F.col("properties")["id"])
    assert measures(back) == WANT
    data.merge_geojson_files(spark, [f"{tmp_path}/c.geojson"] * 2, f"{tmp_path}/m.geojsonl")
    assert data.feature_count(spark, f"{tmp_path}/m.geojsonl") == 6


def test_geoparquet(spark, tmp_path):
    data.write_data(shapes(spark), f"{tmp_path}/a.geoparquet")
    meta = data.read_geoparquet_metadata(spark, f"{tmp_path}/a.geoparquet")
    assert meta["columns"]["geometry"]["geometry_types"] == ["LineString", "Point", "Polygon"]
    assert measures(data.read_data(spark, f"{tmp_path}/a.geoparquet")) == WANT


@pytest.mark.parametrize("kind", ["csv", "tsv", "jsonl", "parquet", "orc"])
def test_tables(spark, tmp_path, kind):
    df = spark.range(20).select("id", (F.col("id") * 2.5).alias("v"))
    data.write_data(df, f"{tmp_path}/t.{kind}", "small")
    back = data.read_data(spark, f"{tmp_path}/t.{kind}")
    assert sorted((int(r.id), float(r.v)) for r in back.collect()) == [(i, i * 2.5) for i in range(20)]


def test_limit_comes_before_where(spark, tmp_path):
    (tmp_path / "p.csv").write_text("id,x,y\n" + "".join(f"{i},{i},{i}\n" for i in range(10)))
    got = data.read_data(spark, f"{tmp_path}/p.csv", limit=5, where="id >= 3", x="x", y="y")
    assert sorted(int(r.id) for r in got.collect()) == [3, 4] and "geometry" in got.columns
    assert data.read_data(spark, f"{tmp_path}/p.csv", sample_step=3, columns=["id"]).count() == 4
    with pytest.raises(ValueError):
        data.read_data(spark, f"{tmp_path}/p.unknown")


def test_feather(spark, tmp_path):
    with pa.OSFile(f"{tmp_path}/a.feather", "wb") as f, pa.ipc.new_file(f, pa.schema([("id", pa.int64()), ("s", pa.string())])) as w:
        w.write_table(pa.table({"id": [1, 2], "s": ["a", None]}))
    assert sorted(map(tuple, data.read_data(spark, f"{tmp_path}/a.feather").collect())) == [(1, "a"), (2, None)]


def test_xml_features(spark, tmp_path):
    (tmp_path / "a.gpx").write_text('<gpx><wpt lat="2" lon="1"><name>a</name></wpt><wpt lat="4" lon="3"><name>b</name></wpt></gpx>')
    assert data.quick_bounds(data.read_data(spark, f"{tmp_path}/a.gpx")) == (1.0, 2.0, 3.0, 4.0)
    (tmp_path / "a.kml").write_text("<kml><Document><Placemark><name>p</name><Point><coordinates>1,2,0</coordinates></Point></Placemark><Placemark><name>l</name><LineString><coordinates>0,0 3,4</coordinates></LineString></Placemark></Document></kml>")
    got = {r.name: r.n for r in data.read_data(spark, f"{tmp_path}/a.kml").select("name", geo.length(F.col("geometry")).alias("n")).collect()}
    assert got == {"p": 0.0, "l": 5.0}


def test_schemas(spark):
    df = spark.createDataFrame([(1, " a "), (2, None)], "`A b` long, t string")
    assert data.standardize_columns(df).columns == ["a_b", "t"]
    assert {r.column: r.nulls for r in data.schema_report(df.toDF("a", "t")).collect()} == {"a": 0, "t": 1}
    assert data.validate_schema(df, {"t": "bigint", "z": "string"}, strict=True) == ["z is missing", "t is string, not bigint", "A b isn't expected"]
    assert [s["step"] for s in data.schema_migration_plan(df, {"t": "bigint", "z": "string"})] == ["cast", "add", "drop"]
    other = data.apply_schema_mapping(df, {"t": "u"}, {"A b": "string"})
    assert data.schema_diff(df.schema, other.schema) == {"added": {"u": "string"}, "removed": {"t": "string"}, "changed": {"A b": ("bigint", "string")}}


def test_dates_and_coordinates(spark):
    df = spark.createDataFrame([("2024-01-02", "200", "1"), ("01/02/2024", "x", "1"), ("nothing", "-5", "95")], "d string, longitude string, latitude string")
    assert [str(r[0])[:10] if r[0] else None for r in df.select(data.parse_datetime(F.col("d"))).collect()] == ["2024-01-02", "2024-01-02", None]
    assert sorted((r.longitude, r.latitude) for r in data.clean_coordinates(df).collect()) == [(-5.0, 90.0), (180.0, 1.0)]


def test_duckdb_and_encoding(spark, tmp_path):
    assert data.write_duckdb(spark.range(3), "t", f"{tmp_path}/d.duckdb") == 3
    assert data.read_duckdb(spark, "SELECT sum(id) AS s FROM t", f"{tmp_path}/d.duckdb").head()[0] == 3
    (tmp_path / "l.txt").write_bytes("café crème".encode("latin-1"))
    (tmp_path / "u.txt").write_bytes("café crème".encode())
    assert [data.detect_encoding(spark, f"{tmp_path}/{n}.txt") for n in "lu"] == ["latin-1", "utf-8"]
