"""Reading and writing by suffix, schemas and their changes, and formats of features. Everything is read by Spark's own readers where it has one."""

from __future__ import annotations

import codecs
import json
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import geometry as geo

#: Sizes of work by preset: bytes of a read partition and records of a written file.
PRESETS = {"small": (16 << 20, 100_000), "medium": (64 << 20, 500_000), "large": (128 << 20, 2_000_000), "huge": (256 << 20, 5_000_000)}
#: What to_datetime formats are tried, in order.
DATES = ["yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "dd.MM.yyyy", "yyyyMMdd"]


def get_workload_preset(name: str) -> dict[str, int]:
    if name not in PRESETS:
        raise ValueError(f"preset is one of {sorted(PRESETS)}")
    return dict(zip(("partition_bytes", "records_per_file"), PRESETS[name], strict=True))


def _suffix(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1].lower().removesuffix(".gz").removesuffix(".bz2")
    return name.rsplit(".", 1)[-1] if "." in name else ""


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """properties' fields as text and geometry, of a FeatureCollection or of one feature a line; holes are dropped."""
    feature = "struct<type:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>"
    raw = spark.read.text(path, wholetext=True)
    features = raw.select(F.from_json("value", f"struct<features:array<{feature}>>").alias("c"), "value")
    whole = features.filter("c.features is not null").select(F.explode("c.features").alias("f"))
    single = features.filter("c.features is null").select(F.explode(F.split("value", "\n")).alias("line")).select(F.from_json("line", feature).alias("f")).filter("f.geometry is not null")
    return whole.unionByName(single).select("f.properties", from_coordinates(F.col("f.geometry.type"), F.col("f.geometry.coordinates")).alias("geometry"))


def from_coordinates(kind: Column, text: Column) -> Column:
    """Geometry of GeoJSON's type and coordinates as text."""
    pair = lambda c: geo.xy(c[0], c[1])
    seq = lambda c: F.transform(c, pair)
    one, two = F.from_json(text, "array<double>"), F.from_json(text, "array<array<double>>")
    three, four = F.from_json(text, "array<array<array<double>>>"), F.from_json(text, "array<array<array<array<double>>>>")
    shape = (
        F.when(kind == "Point", F.array(F.array(pair(one))))
        .when(kind == "LineString", F.array(seq(two)))
        .when(kind == "MultiPoint", F.transform(two, lambda c: F.array(pair(c))))
        .when(kind == "Polygon", F.array(geo.closed(seq(three[0]))))
        .when(kind == "MultiLineString", F.transform(three, seq))
        .when(kind == "MultiPolygon", F.transform(four, lambda rings: geo.closed(seq(rings[0]))))
    )
    return F.when(kind.isNotNull(), geo.geometry(kind, shape))


def coordinates(g: Column) -> Column:
    """GeoJSON text of any of the six kinds."""
    pairs = lambda p: F.transform(p, lambda v: F.array(v["x"], v["y"]))
    text = lambda c: F.to_json(F.struct(g["type"].alias("type"), c.alias("coordinates")))
    several = F.transform(g["parts"], pairs)
    return (
        F.when(g["type"] == "Point", text(several[0][0]))
        .when(g["type"] == "LineString", text(several[0]))
        .when(g["type"] == "MultiPoint", text(F.transform(several, lambda p: p[0])))
        .when(g["type"] == "Polygon", text(several))
        .when(g["type"] == "MultiLineString", text(several))
        .otherwise(text(F.transform(several, lambda p: F.array(p))))
    )


def features(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """One GeoJSON feature a row, as text in value."""
    properties = F.to_json(F.struct(*[c for c in df.columns if c != geometry])) if len(df.columns) > 1 else F.lit("{}")
    return df.select(F.concat(F.lit('{"type":"Feature","geometry":'), coordinates(F.col(geometry)), F.lit(',"properties":'), properties, F.lit("}")).alias("value"))


def write_geojsonl(df: DataFrame, path: str, geometry: str = "geometry", compress: bool = False) -> None:
    features(df, geometry).write.mode("overwrite").option("compression", "gzip" if compress else "none").text(path)


def feature_collection(df: DataFrame, geometry: str = "geometry", most: int = 100_000) -> dict[str, Any]:
    """A FeatureCollection with its bounds and count; refuses more features than most, as it is one value on the driver."""
    rows = features(df, geometry).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} features; write them as lines")
    b = quick_bounds(df, geometry)
    return {"type": "FeatureCollection", "bbox": list(b), "count": len(rows), "features": [json.loads(r[0]) for r in rows]}


def read_points(spark: SparkSession, path: str, geometry: str = "geometry") -> DataFrame:
    """JSON records whose geometry is [x, y]."""
    df = spark.read.json(path, multiLine=True)
    return df.withColumn(geometry, geo.point(F.col(geometry)[0], F.col(geometry)[1]))


def read_xml_features(spark: SparkSession, path: str, row: str, x: str, y: str) -> DataFrame:
    """Elements of an XML format, with points from two of their fields (GPX way points: row wpt, x _lon, y _lat)."""
    df = spark.read.format("xml").option("rowTag", row).load(path)
    return df.withColumn("geometry", geo.point(F.col(x).cast("double"), F.col(y).cast("double")))


def read_gpx(spark: SparkSession, path: str) -> DataFrame:
    return read_xml_features(spark, path, "wpt", "_lon", "_lat")


def read_kml(spark: SparkSession, path: str) -> DataFrame:
    """name and geometry of placemarks that are points, lines or polygons' outer rings."""
    schema = "name string, Point struct<coordinates:string>, LineString struct<coordinates:string>, Polygon struct<outerBoundaryIs:struct<LinearRing:struct<coordinates:string>>>"
    df = spark.read.schema(schema).format("xml").option("rowTag", "Placemark").load(path)
    pairs = lambda c: F.transform(F.filter(F.split(F.trim(c), r"\s+"), lambda t: t != ""), lambda t: geo.xy(F.split(t, ",")[0], F.split(t, ",")[1]))
    p, l, a = F.col("Point.coordinates"), F.col("LineString.coordinates"), F.col("Polygon.outerBoundaryIs.LinearRing.coordinates")  # noqa: E741
    g = F.when(p.isNotNull(), geo.geometry("Point", F.array(pairs(p)))).when(l.isNotNull(), geo.geometry("LineString", F.array(pairs(l)))).when(a.isNotNull(), geo.geometry("Polygon", F.array(geo.closed(pairs(a)))))
    return df.select("name", g.alias("geometry"))


def read_data(spark: SparkSession, path: str, columns: list[str] | None = None, limit: int | None = None, sample_step: int = 1, where: str | None = None, x: str | None = None, y: str | None = None, geometry: str | None = None, preset: str | None = None) -> DataFrame:
    """By suffix: csv, tsv, json, jsonl, geojson, geojsonl, parquet, geoparquet, orc, feather, gpx, kml. Rows are limited and sampled before where is applied.

    x and y make points, geometry names a column of well-known text. sample_step keeps every so many-th row of a file's order.
    """
    kind = _suffix(path)
    if preset:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(get_workload_preset(preset)["partition_bytes"]))
    readers = {
        "csv": lambda: spark.read.csv(path, header=True), "tsv": lambda: spark.read.csv(path, header=True, sep="\t"), "txt": lambda: spark.read.csv(path, header=True, sep="\t"),
        "json": lambda: spark.read.json(path, multiLine=True), "jsonl": lambda: spark.read.json(path), "ndjson": lambda: spark.read.json(path), "geojson": lambda: read_geojson(spark, path), "geojsonl": lambda: read_geojson(spark, path),
        "parquet": lambda: spark.read.parquet(path), "geoparquet": lambda: read_geoparquet(spark, path), "orc": lambda: spark.read.orc(path), "feather": lambda: read_feather(spark, path), "arrow": lambda: read_feather(spark, path),
        "gpx": lambda: read_gpx(spark, path), "kml": lambda: read_kml(spark, path),
    }
    if kind not in readers:
        raise ValueError(f"no reader for .{kind}")
    df = readers[kind]()
    if limit is not None:
        df = df.limit(limit)
    if sample_step > 1:
        df = df.withColumn("_n", F.monotonically_increasing_id()).filter(F.col("_n").bitwiseAND(F.lit((1 << 33) - 1)) % sample_step == 0).drop("_n")
    if where:
        df = df.where(where)
    if x and y:
        df = df.withColumn("geometry", geo.point(F.col(x).cast("double"), F.col(y).cast("double")))
    if geometry:
        df = df.withColumn("geometry", geo.from_wkt(F.col(geometry)))
    return df.select(*columns) if columns else df


read_file = read_data


def write_data(df: DataFrame, path: str, preset: str | None = None) -> None:
    """By suffix: csv, tsv, json (lines), jsonl, geojsonl, parquet, geoparquet, orc."""
    kind = _suffix(path)
    w = df.write.mode("overwrite")
    if preset:
        w = w.option("maxRecordsPerFile", get_workload_preset(preset)["records_per_file"])
    if kind in ("csv", "tsv"):
        w.option("header", True).option("sep", "," if kind == "csv" else "\t").csv(path)
    elif kind in ("json", "jsonl"):
        w.json(path)
    elif kind in ("geojson", "geojsonl"):
        write_geojsonl(df, path)
    elif kind == "parquet":
        w.parquet(path)
    elif kind == "geoparquet":
        write_geoparquet(df, path)
    elif kind == "orc":
        w.orc(path)
    else:
        raise ValueError(f"no writer for .{kind}")


to_file = write_data


def write_geoparquet(df: DataFrame, path: str, geometry: str = "geometry", crs: str | None = None) -> None:
    """Parquet with geometries as well-known binary, and beside the files _geo.json with the format's metadata: column, encoding, kinds, bounds."""
    kinds = sorted(r[0] for r in df.select(geo.kind(F.col(geometry))).distinct().collect() if r[0])
    meta = {"version": "1.0.0", "primary_column": geometry, "columns": {geometry: {"encoding": "WKB", "geometry_types": kinds, "bbox": list(quick_bounds(df, geometry)), "crs": crs}}}
    df.withColumn(geometry, geo.wkb(F.col(geometry))).write.mode("overwrite").parquet(path)
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_geo.json")
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(json.dumps(meta).encode()))
    out.close()


def read_geoparquet_metadata(spark: SparkSession, path: str) -> dict[str, Any]:
    # Spark's readers pass over files whose names start with _, so that the table beside it is read alone.
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_geo.json")
    source = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
    finally:
        source.close()


def read_geoparquet(spark: SparkSession, path: str) -> DataFrame:
    g = read_geoparquet_metadata(spark, path)["primary_column"]
    return spark.read.parquet(path).withColumn(g, geo.from_wkb(F.col(g)))


def read_feather(spark: SparkSession, path: str) -> DataFrame:
    """Arrow files, each decoded by a task of its own."""
    import pyarrow as pa

    head = spark.read.format("binaryFile").load(path).select("content").limit(1).collect()
    if not head:
        raise ValueError(f"nothing at {path}")
    table = pa.ipc.open_file(pa.BufferReader(bytes(head[0][0])))
    from pyspark.sql.pandas.types import from_arrow_schema

    schema = from_arrow_schema(table.schema)

    def decode(batches):
        for b in batches:
            for content in b.column(0).to_pylist():
                reader = pa.ipc.open_file(pa.BufferReader(content))
                for i in range(reader.num_record_batches):
                    yield reader.get_batch(i)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(decode, schema)


def read_glob(spark: SparkSession, pattern: str) -> DataFrame:
    """Lines of JSON of all files that match, with the file of each row."""
    return spark.read.json(pattern).select("*", F.col("_metadata.file_path").alias("source_file"))


def merge_geojson_files(spark: SparkSession, paths: list[str], path: str) -> None:
    rows = read_geojson(spark, paths[0])
    for p in paths[1:]:
        rows = rows.unionByName(read_geojson(spark, p))
    write_geojsonl(rows, path)


def feature_count(spark: SparkSession, path: str) -> int:
    return read_data(spark, path).count()


def quick_bounds(df: DataFrame, geometry: str = "geometry") -> tuple[float, float, float, float]:
    b = df.select(geo.bounds(F.col(geometry)).alias("b"))
    return tuple(b.agg(F.min("b.min_x"), F.min("b.min_y"), F.max("b.max_x"), F.max("b.max_y")).head())


def read_parquet_filtered(spark: SparkSession, path: str, columns: list[str] | None = None, row_filter: str | None = None) -> DataFrame:
    """Both reach the scan."""
    df = spark.read.parquet(path)
    df = df.where(row_filter) if row_filter else df
    return df.select(*columns) if columns else df


# Schemas.


def schema_report(df: DataFrame) -> DataFrame:
    """column, type, rows, nulls and distinct of each column."""
    kinds = dict(df.dtypes)
    one = lambda c: F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("type"), F.count(F.lit(1)).alias("rows"), (F.count(F.lit(1)) - F.count(c)).alias("nulls"), F.approx_count_distinct(c).alias("distinct"))
    return df.agg(F.array(*[one(c) for c in df.columns]).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def schema_diff(old: T.StructType, new: T.StructType) -> dict[str, Any]:
    """added, removed and changed columns."""
    a, b = ({f.name: f.dataType.simpleString() for f in s} for s in (old, new))
    return {"added": {c: b[c] for c in b if c not in a}, "removed": {c: a[c] for c in a if c not in b}, "changed": {c: (a[c], b[c]) for c in a if c in b and a[c] != b[c]}}


def validate_schema(df: DataFrame, expected: dict[str, str], strict: bool = False) -> list[str]:
    """What is missing or of another type, and, if strict, what is there besides."""
    have = dict(df.dtypes)
    out = [f"{c} is missing" for c in expected if c not in have]
    out += [f"{c} is {have[c]}, not {kind}" for c, kind in expected.items() if c in have and have[c] != kind]
    return out + [f"{c} isn't expected" for c in have if strict and c not in expected]


def schema_migration_plan(df: DataFrame, target: dict[str, str]) -> list[dict[str, str]]:
    """Steps that make the schema the target: cast, add, drop."""
    have = dict(df.dtypes)
    steps = [{"step": "cast", "column": c, "from": have[c], "to": k} for c, k in target.items() if c in have and have[c] != k]
    steps += [{"step": "add", "column": c, "to": k} for c, k in target.items() if c not in have]
    return steps + [{"step": "drop", "column": c} for c in have if c not in target]


def apply_schema_mapping(df: DataFrame, rename: dict[str, str] | None = None, casts: dict[str, str] | None = None) -> DataFrame:
    """Renamed, then cast by the new names."""
    df = df.withColumnsRenamed(rename or {})
    return df.withColumns({c: F.col(c).cast(k) for c, k in (casts or {}).items()})


def apply_field_aliases(df: DataFrame, aliases: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(aliases)


def standardize_columns(df: DataFrame, lower: bool = True, space: str = "_") -> DataFrame:
    """Names without outer space, in lower case, with something for each space within."""
    name = lambda c: (c.strip().lower() if lower else c.strip()).replace(" ", space)
    return df.toDF(*[name(c) for c in df.columns])


def clean_coordinates(df: DataFrame, x: str = "longitude", y: str = "latitude") -> DataFrame:
    """Longitudes and latitudes as numbers within their ranges; rows without them go."""
    lon, lat = F.col(x).try_cast("double"), F.col(y).try_cast("double")
    within = lambda v, most: F.when(v.isNotNull(), F.greatest(F.lit(-most), F.least(F.lit(most), v)))
    return df.withColumns({x: within(lon, 180.0), y: within(lat, 90.0)}).dropna(subset=[x, y])


def parse_datetime(c: Column) -> Column:
    """A timestamp by the first format of DATES that fits, or null."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in DATES])


def detect_encoding(spark: SparkSession, path: str, size: int = 8192) -> str:
    """utf-8, utf-16 or latin-1, from the first bytes of a file."""
    raw = bytes(spark.read.format("binaryFile").load(path).select(F.substring("content", 1, size)).head()[0])
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return "utf-16"
    try:
        # A character cut off at the end of the sample is no error.
        codecs.getincrementaldecoder("utf-8")().decode(raw, final=len(raw) < size)
    except UnicodeDecodeError:
        return "latin-1"
    return "utf-8"


def read_duckdb(spark: SparkSession, query: str, database: str = ":memory:") -> DataFrame:
    """A query's rows, by way of the driver."""
    import duckdb

    with duckdb.connect(database, read_only=database != ":memory:") as con:
        return spark.createDataFrame(con.execute(query).to_arrow_table())


def write_duckdb(df: DataFrame, table: str, database: str) -> int:
    """A table of a local database, by way of the driver; gives its rows."""
    import duckdb

    rows = df.toArrow()  # noqa: F841
    with duckdb.connect(database) as con:
        con.execute(f'CREATE OR REPLACE TABLE "{table}" AS SELECT * FROM rows')
    return rows.num_rows
