"""Readers and writers of tables and features. Features have a geometry column of lodestone.functions.geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import geometry


def read_csv_points(spark: SparkSession, path: str, x: str, y: str) -> DataFrame:
    """A CSV with a header; values stay text but for the two coordinates."""
    rows = spark.read.option("header", True).csv(path)
    return rows.withColumn("geom", geometry.point(F.col(x), F.col(y)))


def read_csv_wkt(spark: SparkSession, path: str, shape: str) -> DataFrame:
    rows = spark.read.option("header", True).option("quote", '"').csv(path)
    return rows.withColumn("geom", geometry.from_wkt(F.col(shape)))


def read_geojsonl(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """A feature a line. properties: DDL of their columns."""
    rows = spark.read.text(path)
    one = F.from_json("value", f"type string, geometry struct<type:string,coordinates:string>, properties struct<{properties}>")
    rows = rows.select(one.alias("f"))
    kind, c = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    pairs = lambda a: F.transform(a, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    parts = F.when(kind == "Point", F.array(pairs(F.array(F.from_json(c, "array<double>"))))).when(kind.isin("LineString", "MultiPoint"), F.array(pairs(F.from_json(c, "array<array<double>>")))).when(kind == "Polygon", F.slice(F.transform(F.from_json(c, "array<array<array<double>>>"), pairs), 1, 1))
    return rows.select("f.properties.*", F.struct(kind.alias("type"), parts.alias("parts")).alias("geom"))


def write_geojsonl(features: DataFrame, path: str, geom: str = "geom") -> None:
    props = F.struct(*[c for c in features.columns if c != geom])
    text = F.concat(F.lit('{"type":"Feature","geometry":'), geometry.geojson(F.col(geom)), F.lit(',"properties":'), F.to_json(props), F.lit("}"))
    features.select(text.alias("value")).write.text(path)


def write_by_cell(features: DataFrame, path: str, size: float) -> None:
    """Parquet by grid cell of x and y, so that box filters prune folders and row groups."""
    cell = lambda c: F.floor(F.col(c) / size)
    features.withColumn("cell_x", cell("x")).withColumn("cell_y", cell("y")).repartition("cell_x", "cell_y").write.partitionBy("cell_x", "cell_y").parquet(path)
