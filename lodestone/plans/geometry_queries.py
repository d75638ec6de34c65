"""Queries on geometries: triangles, lines and boxes made from parts, with measures and predicates in closed form as SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.frame import Frame
from lodestone.functions import geometry as geo
from lodestone.operators import spatial
from lodestone.plans.catalog import POINTS, ZONES, query
from lodestone.scratch import spread

c, lit = F.col, F.lit
_X = "x AS (SELECT p_partkey AS id, p_size::DOUBLE AS s, p_size % 7 + 1.0::DOUBLE AS h, (p_partkey % 10)::DOUBLE AS u, (p_partkey % 6)::DOUBLE AS w FROM part)"


def _x(t):
    """id, s and h: a triangle (0, 0), (s, 0), (0, h); a line (0, 0), (s, 0), (s, h); a place (u, w)."""
    p = t.part.select(c("p_partkey").alias("id"), c("p_size").cast("double").alias("s"), (c("p_size") % 7 + lit(1.0)).alias("h"), (c("p_partkey") % 10).cast("double").alias("u"), (c("p_partkey") % 6).cast("double").alias("w"))
    o = lit(0.0)
    # The functions take up to a millisecond a row, and the file may be one task.
    p = spread(p, p.count(), 20_000)
    return p.withColumns({"tri": geo.polygon((o, o), (c("s"), o), (o, c("h"))), "path": geo.line((o, o), (c("s"), o), (c("s"), c("h"))), "at": geo.point(c("u"), c("w")), "box": geo.rectangle(lit(2.0), lit(1.0), lit(8.0), lit(4.0))})


@query(f"WITH {_X} SELECT id, s * h / 2 AS area, s + h + sqrt(s * s + h * h) AS perimeter, s / 3 AS cx, h / 3 AS cy, s + h AS length, s AS max_x, h AS max_y, 4 AS n, 4 * pi() * (s * h / 2) / pow(s + h + sqrt(s * s + h * h), 2) AS compact, sqrt(s * s + h * h) AS longest, ((degrees(atan2(s, h)) % 360) + 360) % 360 AS azimuth, (s + h) / sqrt(s * s + h * h) AS sinuosity FROM x")
def shape_measures(t):
    tri, path = c("tri"), c("path")
    return _x(t).select(
        "id", geo.area(tri).alias("area"), geo.length(tri).alias("perimeter"), geo.centroid(tri)["x"].alias("cx"), geo.centroid(tri)["y"].alias("cy"), geo.length(path).alias("length"), geo.bounds(tri)["max_x"].alias("max_x"), geo.bounds(tri)["max_y"].alias("max_y"),
        geo.n_vertices(tri).alias("n"), geo.compactness(tri).alias("compact"), geo.longest_side(tri).alias("longest"), geo.azimuth(path).alias("azimuth"), geo.sinuosity(path).alias("sinuosity"),
    )


@query(f"WITH {_X} SELECT id, u >= 0 AND w >= 0 AND u / s + w / h <= 1 + 1e-9 AS inside, (w = 0 AND u <= s) OR (u = s AND w <= h) AS on_path, s >= 2 AND h >= 1 AND 2 / s + 1 / h <= 1 + 1e-9 AS meets_box, u BETWEEN 2 AND 8 AND w BETWEEN 1 AND 4 AS in_box, NOT (u BETWEEN 2 AND 8 AND w BETWEEN 1 AND 4) AS apart, u > 2 AND u < 8 AND w > 1 AND w < 4 AS properly, (u BETWEEN 2 AND 8 AND w BETWEEN 1 AND 4) AND NOT (u > 2 AND u < 8 AND w > 1 AND w < 4) AS touch, u <= s AND w <= h AS bounds_meet, s <= 6 AND h <= 5 AS bounds_within FROM x")
def shape_predicates(t):
    tri, path, at, box = c("tri"), c("path"), c("at"), c("box")
    return _x(t).select(
        "id", geo.within(at, tri).alias("inside"), geo.intersects(at, path).alias("on_path"), geo.intersects(tri, box).alias("meets_box"), geo.covers(box, at).alias("in_box"), geo.disjoint(box, at).alias("apart"),
        geo.contains_properly(box, at).alias("properly"), geo.touches(box, at).alias("touch"), geo.intersects_bounds(tri, c("u"), c("w"), c("u") + 1, c("w") + 1).alias("bounds_meet"), geo.within_bounds(tri, lit(0.0), lit(0.0), lit(6.0), lit(5.0)).alias("bounds_within"),
    )


@query(f"WITH {_X} SELECT id, s > 2 AND s < 8 AND h > 1 AS crosses, 2 < s AND 1 < h AND 2 / s + 1 / h < 1 - 1e-9 AND NOT (s >= 8 AND h >= 4 AND 8 / s + 4 / h <= 1 + 1e-9) AS overlaps, u = 0 AND w = 0 AS same, w = 0 AND u = 0 AS same_again FROM x")
def shape_relations(t):
    tri, path, box = c("tri"), c("path"), c("box")
    moved = geo.translated(tri, c("u"), c("w"))
    return _x(t).select("id", geo.crosses(path, box).alias("crosses"), geo.overlaps(tri, box).alias("overlaps"), geo.equals(tri, moved).alias("same"), (geo.hashed(tri) == geo.hashed(moved)).alias("same_again"))


@query(f"WITH {_X} SELECT id, (s * 2 + 1) * 1.0 AS t_max_x, s / 3 + (s - s / 3) * 2 AS scaled_x, 4 * s * h / 2 AS scaled_area, s * h / 2 AS rotated_area, h AS swapped_x, s * h / 2 AS hull_area, s * h AS envelope_area, s * h / 2 AS skewed_area, 2 * s + h AS affine_x FROM x")
def shape_maps(t):
    tri = c("tri")
    top = lambda g: geo.bounds(g)["max_x"]
    return _x(t).select(
        "id", top(geo.translated(tri, c("s") + 1, 0.0)).alias("t_max_x"), top(geo.scaled(tri, 2.0)).alias("scaled_x"), geo.area(geo.scaled(tri, 2.0)).alias("scaled_area"), geo.area(geo.rotated(tri, 33.0)).alias("rotated_area"), top(geo.swapped(tri)).alias("swapped_x"),
        geo.area(geo.convex_hull(tri)).alias("hull_area"), geo.area(geo.envelope(tri)).alias("envelope_area"), geo.area(geo.skewed(tri, 30.0)).alias("skewed_area"), geo.bounds(geo.affine(c("path"), 2.0, 1.0, 0.0, 1.0))["max_x"].alias("affine_x"),
    )


@query(f"WITH {_X}, y AS (SELECT *, (s + h) * 0.5::DOUBLE AS m FROM x) SELECT id, CASE WHEN m <= s THEN m ELSE s END AS half_x, CASE WHEN m <= s THEN 0 ELSE m - s END AS half_y, least(sqrt(pow(greatest(u - s, 0), 2) + w * w), sqrt(pow(s - u, 2) + pow(greatest(w - h, 0), 2))) AS away, (s + h) * 0.25::DOUBLE AS quarter, 3 AS n_along, (floor((s + h) / 2) + 1)::INTEGER AS n_every, s + h AS dense FROM y")
def along_lines(t):
    path = c("path")
    half = geo.vertices(geo.interpolated(path, 0.5))[0]
    return _x(t).select(
        "id", half["x"].alias("half_x"), half["y"].alias("half_y"), geo.located(path, c("u"), c("w"))["distance"].alias("away"), geo.length(geo.substring(path, 0.5, 0.75)).alias("quarter"),
        F.size(geo.points_along(path, 3)).alias("n_along"), F.size(geo.points_every(path, 2.0)).alias("n_every"), geo.length(geo.densified(path, 0.7)).alias("dense"),
    )


@query(f"WITH {_X} SELECT id, greatest(0, sqrt(pow(greatest(2 - u, 0, u - 8), 2) + pow(greatest(1 - w, 0, w - 4), 2))) AS least, sqrt(pow(u - 5, 2) + pow(w - 2.5, 2)) AS centres, sqrt(pow(greatest(2 - u, 0, u - 8), 2) + pow(greatest(1 - w, 0, w - 4), 2)) <= 1.5 AS near, sqrt(u * u + w * w) AS hausdorff, sqrt(u * u + w * w) AS frechet FROM x")
def shape_distances(t):
    path, at, box = c("path"), c("at"), c("box")
    moved = geo.translated(geo.line((lit(0.0), lit(0.0)), (lit(100.0), lit(0.0))), c("u"), c("w"))
    base = geo.line((lit(0.0), lit(0.0)), (lit(100.0), lit(0.0)))
    return _x(t).select("id", geo.least_distance(at, box).alias("least"), geo.distance(at, box).alias("centres"), geo.dwithin(at, box, 1.5).alias("near"), geo.hausdorff(base, moved).alias("hausdorff"), geo.frechet(base, moved).alias("frechet"))


@query(f"WITH {_X} SELECT id, greatest(0, least(s, 8) - 2) * greatest(0, least(h, 4) - 1) AS clip_area, 32 * s * s / 2 * sin(2 * pi() / 32) AS circle_area, 72 * s * h / 2 * sin(2 * pi() / 72) AS ellipse_area, 2 * 32 * s * sin(radians(90) / 64) AS arc_length, s AS ring_area, sqrt(s * s + h * h) / 2 AS radius, s * h AS oriented FROM x")
def shape_constructions(t):
    box = geo.rectangle(lit(0.0), lit(0.0), c("s"), c("h"))
    turned = geo.rotated(box, 25.0)
    return _x(t).select(
        "id", F.coalesce(geo.area(geo.clipped(box, 2.0, 1.0, 8.0, 4.0)), lit(0.0)).alias("clip_area"), geo.area(geo.circle(c("u"), c("w"), c("s"), 32)).alias("circle_area"), geo.area(geo.ellipse(c("u"), c("w"), c("s"), c("h"), 40.0)).alias("ellipse_area"),
        geo.length(geo.arc(c("u"), c("w"), c("s"), 0.0, 90.0)).alias("arc_length"), geo.length(geo.bezier([(lit(0.0), lit(0.0)), (c("s") / 2, lit(0.0)), (c("s"), lit(0.0))])).alias("ring_area"), geo.bounding_circle(box)["radius"].alias("radius"), geo.rotated_rectangle(turned)["area"].alias("oriented"),
    )


@query(f"WITH {_X} SELECT id, 'clockwise_exterior' AS issues, 's' AS none, s * h / 2 AS repaired, 4 AS n, 3 AS unrepeated, 1 AS parts, s + h + sqrt(s * s + h * h) AS ring, s * h / 2 AS smooth_less FROM x WHERE h > 2 AND s > 2")
def shape_validity(t):
    o = lit(0.0)
    wrong = geo.polygon((o, o), (o, c("h")), (c("s"), o))
    twice = geo.line((o, o), (o, o), (c("s"), o), (c("s"), c("h")))
    smooth = geo.area(geo.smoothed(c("tri"), 1))
    return _x(t).filter("h > 2 and s > 2").select(
        "id", F.array_join(geo.issues(wrong, 0.0), ",").alias("issues"), F.when(geo.validity(c("box"))["is_valid"], "s").alias("none"), geo.area(geo.repair(wrong)).alias("repaired"), geo.n_vertices(geo.canonical(wrong)).alias("n"),
        geo.n_vertices(geo.without_repeats(twice)).alias("unrepeated"), geo.n_parts(c("tri")).alias("parts"), geo.length(geo.exterior_ring(c("tri"))).alias("ring"), (smooth + (c("s") * c("h") / 2 - smooth)).alias("smooth_less"),
    )


@query(f"WITH {_X} SELECT id, s * h / 2 AS wkb_area, 'POINT (' || u || ' ' || w || ')' AS wkt, s + h AS wkt_length, 2 AS kept FROM x")
def geometry_formats(t):
    back = geo.from_wkb(geo.wkb(c("tri")))
    flat = geo.line((lit(0.0), lit(0.0)), (c("s") / 2, lit(0.001)), (c("s"), lit(0.0)))
    return _x(t).select("id", geo.area(back).alias("wkb_area"), geo.to_wkt(c("at")).alias("wkt"), geo.length(geo.from_wkt(geo.to_wkt(c("path")))).alias("wkt_length"), geo.n_vertices(geo.simplified(flat, 0.01)).alias("kept"))


_LL = "l AS (SELECT c_custkey AS id, ((c_custkey * 37) % 3600) / 10.0::DOUBLE - 180 AS lon, ((c_custkey * 53) % 1700) / 10.0::DOUBLE - 85 AS lat FROM customer)"


@query(f"WITH {_LL}, r AS (SELECT *, degrees(asin(sin(radians(lat)) * cos(1e5 / 6371008.8) + cos(radians(lat)) * sin(1e5 / 6371008.8) * cos(radians(60)))) AS to_lat FROM l) SELECT id, ((degrees(atan2(sin(radians(10 - lon)) * cos(radians(20)), cos(radians(lat)) * sin(radians(20)) - sin(radians(lat)) * cos(radians(20)) * cos(radians(10 - lon)))) % 360) + 360) % 360 AS bearing, to_lat, 6371008.8::DOUBLE * radians(1) AS degree FROM r")
def geodesics(t):
    p = t.places()
    line = geo.line((c("lon"), c("lat")), (c("lon"), c("lat") + 1))
    return p.select("id", geo.geodesic_bearing(c("lon"), c("lat"), lit(10.0), lit(20.0)).alias("bearing"), geo.destination(c("lon"), c("lat"), lit(60.0), lit(1e5))["y"].alias("to_lat"), geo.geodesic_length(line).alias("degree"))


_Z = f"{POINTS}, {ZONES}"


@query(f"WITH {_Z} SELECT p.id, zone.id AS id_zone FROM p JOIN zone ON p.x BETWEEN min_x AND max_x AND p.y BETWEEN min_y AND max_y")
def frame_spatial_join(t):
    p = Frame.from_points(t.points().select("id", "x", "y"), "x", "y")
    z = Frame(t.zones().select("id", geo.rectangle(c("min_x"), c("min_y"), c("max_x"), c("max_y")).alias("geometry")))
    return p.spatial_join(z, "within").df.select(c("id_left").alias("id"), c("id_right").alias("id_zone"))


@query(f"WITH {_Z} SELECT zone.id, p.id AS id_point FROM zone LEFT JOIN p ON p.x BETWEEN min_x AND max_x AND p.y BETWEEN min_y AND max_y")
def frame_spatial_join_left(t):
    p = Frame.from_points(t.points().select("id", "x", "y"), "x", "y")
    z = Frame(t.zones().select("id", geo.rectangle(c("min_x"), c("min_y"), c("max_x"), c("max_y")).alias("geometry")))
    return z.spatial_join(p, "contains", "left").df.select(c("id_left").alias("id"), c("id_right").alias("id_point"))


_BUF = f"{_Z}, b AS (SELECT id, min_x - 0.02::DOUBLE AS min_x, min_y - 0.02::DOUBLE AS min_y, max_x + 0.03::DOUBLE AS max_x, max_y + 0.03::DOUBLE AS max_y FROM zone)"


@query(f"WITH {_BUF} SELECT a.id AS id_left, b.id AS id_right, greatest(a.min_x, b.min_x) AS min_x, greatest(a.min_y, b.min_y) AS min_y, least(a.max_x, b.max_x) AS max_x, least(a.max_y, b.max_y) AS max_y, (least(a.max_x, b.max_x) - greatest(a.min_x, b.min_x)) * (least(a.max_y, b.max_y) - greatest(a.min_y, b.min_y)) AS area FROM zone a JOIN b ON least(a.max_x, b.max_x) > greatest(a.min_x, b.min_x) AND least(a.max_y, b.max_y) > greatest(a.min_y, b.min_y)")
def rectangle_overlaps(t):
    z = t.zones()
    wide = z.select("id", (c("min_x") - 0.02).alias("min_x"), (c("min_y") - 0.02).alias("min_y"), (c("max_x") + 0.03).alias("max_x"), (c("max_y") + 0.03).alias("max_y"))
    return spatial.rectangle_overlaps(z, wide, 0.1)


@query(f"WITH {_BUF} SELECT a.id AS a, b.id AS b FROM b a JOIN b ON a.id < b.id AND a.min_x <= b.max_x AND b.min_x <= a.max_x AND a.min_y <= b.max_y AND b.min_y <= a.max_y")
def polygon_neighbors(t):
    wide = t.zones().select("id", geo.rectangle(c("min_x") - 0.02, c("min_y") - 0.02, c("max_x") + 0.03, c("max_y") + 0.03).alias("geometry"))
    return spatial.polygon_neighbors(wide)


@query(f"WITH {_BUF} SELECT a.id, (SELECT count(*) FROM b WHERE a.min_x <= b.max_x AND b.min_x <= a.max_x AND a.min_y <= b.max_y AND b.min_y <= a.max_y) AS n FROM zone a")
def overlay_summary(t):
    g = lambda lo, hi: geo.rectangle(c("min_x") - lo, c("min_y") - lo, c("max_x") + hi, c("max_y") + hi).alias("geometry")
    return spatial.overlay_summary(t.zones().select("id", g(0.0, 0.0)), t.zones().select("id", g(0.02, 0.03)))


@query(f"WITH {_Z} SELECT min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y, avg(x) AS cx, avg(y) AS cy FROM p")
def frame_bounds(t):
    p = Frame.from_points(t.points(), "x", "y")
    return p.bounds().df.join(p.centroid().df.select(c("x").alias("cx"), c("y").alias("cy")))


@query(f"WITH {_Z} SELECT id FROM p WHERE x BETWEEN -0.1 AND 0.1 AND y BETWEEN -0.05 AND 0.2 AND sqrt(pow(x - 0.05, 2) + pow(y, 2)) <= 0.08")
def frame_query_bounds(t):
    p = Frame.from_points(t.points(), "x", "y")
    return p.query_bounds(-0.1, -0.05, 0.1, 0.2, "centroid").query_radius(0.05, 0.0, 0.08).df.select("id")


@query("SELECT label, count(*) AS n FROM embeddings GROUP BY 1")
def frame_explode_parts(t):
    p = Frame.from_points(t.points(), "x", "y").dissolve_parts("v").explode()
    return p.df.groupBy(c("v").cast("int").alias("label")).agg(F.count("*").alias("n"))


@query(f"WITH {_X} SELECT id, k, CASE k WHEN 1 THEN s ELSE 0 END AS x FROM x, (SELECT unnest([0, 1, 2, 3]) AS k)")
def frame_vertices_to_points(t):
    f = Frame(_x(t).select("id", c("tri").alias("geometry"))).vertices_to_points().df
    from pyspark.sql import Window

    v = geo.vertices(c("geometry"))[0]
    k = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("x"), F.desc("y")))
    rows = f.select("id", v["x"].alias("x"), v["y"].alias("y")).withColumn("k", k)
    # In order of the vertices: 0 first, then s, then two at x = 0.
    return rows.select("id", F.when(c("k") == 1, 1).when(c("k") == 2, 2).when(c("k") == 3, 0).otherwise(3).alias("k"), "x")
