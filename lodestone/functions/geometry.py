"""Planar geometry on columns. A geometry is struct<type, parts: array<array<struct<x, y>>>>; rings are closed, holes dropped."""

from __future__ import annotations

from math import comb, cos, radians, sin

from pyspark.sql import Column
from pyspark.sql import functions as F

GEOMETRY = "struct<type:string,parts:array<array<struct<x:double,y:double>>>>"


def point(x: Column, y: Column) -> Column:
    return F.struct(F.lit("Point").alias("type"), F.array(F.array(F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")))).alias("parts"))


def rectangle(min_x: Column, min_y: Column, max_x: Column, max_y: Column) -> Column:
    corners = [(min_x, min_y), (max_x, min_y), (max_x, max_y), (min_x, max_y), (min_x, min_y)]
    ring = F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in corners])
    return F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("parts"))


def vertices(g: Column) -> Column:
    return F.flatten(g["parts"])


def let(value: Column, body) -> Column:
    """body(value), with value worked out once a row, and held once in the plan."""
    return F.element_at(F.transform(F.array(value), body), 1)


def bounds(g: Column) -> Column:
    def of(v: Column) -> Column:
        xs, ys = F.transform(v, lambda p: p["x"]), F.transform(v, lambda p: p["y"])
        return F.struct(F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"), F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y"))

    return let(vertices(g), of)


def _sides(part: Column) -> Column:
    """Consecutive vertices of a part as structs (a, b)."""
    return F.zip_with(F.slice(part, F.lit(1), F.greatest(F.size(part) - 1, F.lit(0))), F.slice(part, 2, F.size(part)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def length(g: Column) -> Column:
    """Planar length or perimeter; 0 for points."""
    step = lambda s: F.sqrt(F.pow(s["a"]["x"] - s["b"]["x"], 2) + F.pow(s["a"]["y"] - s["b"]["y"], 2))
    return let(g, lambda g: F.when(g["type"].isin("Point", "MultiPoint"), F.lit(0.0)).otherwise(_sum(F.transform(g["parts"], lambda p: _sum(F.transform(_sides(p), step))))))


def _twice_area(part: Column) -> Column:
    return _sum(F.transform(_sides(part), lambda s: s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"]))


def area(g: Column) -> Column:
    """Shoelace area of the outer rings; 0 for points and lines."""
    return let(g, lambda g: F.when(g["type"].isin("Polygon", "MultiPolygon"), _sum(F.transform(g["parts"], lambda p: F.abs(_twice_area(p)) / 2))).otherwise(F.lit(0.0)))


def contains_point(g: Column, x: Column, y: Column) -> Column:
    """Even-odd test in every ring; points on a side count as inside."""
    cross = lambda s: (s["b"]["x"] - s["a"]["x"]) * (y - s["a"]["y"]) - (s["b"]["y"] - s["a"]["y"]) * (x - s["a"]["x"])
    on = lambda s: (F.abs(cross(s)) <= 1e-9) & x.between(F.least(s["a"]["x"], s["b"]["x"]), F.greatest(s["a"]["x"], s["b"]["x"])) & y.between(F.least(s["a"]["y"], s["b"]["y"]), F.greatest(s["a"]["y"], s["b"]["y"]))
    over = lambda s: ((s["a"]["y"] > y) != (s["b"]["y"] > y)) & (x < (s["b"]["x"] - s["a"]["x"]) * (y - s["a"]["y"]) / (s["b"]["y"] - s["a"]["y"]) + s["a"]["x"])
    return F.exists(g["parts"], lambda p: F.exists(_sides(p), on) | (F.size(F.filter(_sides(p), over)) % 2 == 1))


def to_wkt(g: Column) -> Column:
    """Text of a point, line or polygon."""
    pair = lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))
    part = F.array_join(F.transform(g["parts"][0], pair), ", ")
    return F.when(g["type"] == "Point", F.concat(F.lit("POINT ("), part, F.lit(")"))).when(g["type"] == "LineString", F.concat(F.lit("LINESTRING ("), part, F.lit(")"))).when(g["type"] == "Polygon", F.concat(F.lit("POLYGON (("), part, F.lit("))")))


def from_wkt(text: Column) -> Column:
    """Geometry of a POINT, LINESTRING or POLYGON text; null for any other."""
    kind = F.upper(F.regexp_extract(text, r"^\s*([A-Za-z]+)", 1))
    name = F.when(kind == "POINT", "Point").when(kind == "LINESTRING", "LineString").when(kind == "POLYGON", "Polygon")
    ring = F.regexp_extract(text, r"\(+([^()]*)\)", 1)
    pairs = F.transform(F.split(F.trim(ring), r"\s*,\s*"), lambda p: F.split(F.trim(p), r"\s+"))
    part = F.transform(pairs, lambda p: F.struct(F.get(p, F.lit(0)).try_cast("double").alias("x"), F.get(p, F.lit(1)).try_cast("double").alias("y")))
    return F.when(name.isNotNull(), F.struct(name.alias("type"), F.array(part).alias("parts")))


def geojson(g: Column) -> Column:
    """GeoJSON text of a point, line or polygon."""
    pairs = F.transform(g["parts"][0], lambda p: F.array(p["x"], p["y"]))
    text = lambda c: F.to_json(F.struct(g["type"].alias("type"), c.alias("coordinates")))
    return F.when(g["type"] == "Point", text(pairs[0])).when(g["type"] == "LineString", text(pairs)).otherwise(text(F.array(pairs)))


# Kinds, parts and maps of any geometry. Points are parts of one vertex, so a MultiPoint has a part for each.


def kind(g: Column) -> Column:
    return g["type"]


def simple_kind(g: Column) -> Column:
    """Point, LineString or Polygon, of multi-part geometries too."""
    return F.regexp_replace(g["type"], "^Multi", "")


def geometry(type_: str | Column, parts_: Column) -> Column:
    return F.struct((F.lit(type_) if isinstance(type_, str) else type_).alias("type"), parts_.alias("parts"))


def xy(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def line(*pairs: tuple[Column, Column]) -> Column:
    return geometry("LineString", F.array(F.array(*[xy(*p) for p in pairs])))


def polygon(*pairs: tuple[Column, Column]) -> Column:
    """The ring is closed here."""
    return geometry("Polygon", F.array(F.array(*[xy(*p) for p in (*pairs, pairs[0])])))


def parts(g: Column) -> Column:
    """Array of simple geometries."""
    return F.transform(g["parts"], lambda p: geometry(simple_kind(g), F.array(p)))


def closed(ring: Column) -> Column:
    """A ring whose last vertex is its first."""
    return let(ring, lambda r: F.when(F.element_at(r, 1) == F.element_at(r, -1), r).otherwise(F.concat(r, F.array(F.element_at(r, 1)))))


def normalize(g: Column) -> Column:
    """Polygons closed, others as they are."""
    return F.when(simple_kind(g) == "Polygon", geometry(g["type"], F.transform(g["parts"], closed))).otherwise(g)


def mapped(g: Column, f) -> Column:
    """g with f(x, y) -> (x, y) on every vertex."""

    def go(p: Column) -> Column:
        x, y = f(p["x"], p["y"])
        return xy(x, y)

    return geometry(g["type"], F.transform(g["parts"], lambda r: F.transform(r, go)))


def translated(g: Column, dx: float | Column, dy: float | Column) -> Column:
    return mapped(g, lambda x, y: (x + dx, y + dy))


def _about(g: Column, origin: Column | None, f) -> Column:
    """g with f(x, y, o) on every vertex, o being origin or the centroid. The type stays outside of what is worked out once, so that asking for it costs nothing."""
    return geometry(g["type"], let(centroid(g) if origin is None else origin, lambda o: mapped(g, lambda x, y: f(x, y, o))["parts"]))


def scaled(g: Column, sx: float, sy: float | None = None, origin: Column | None = None) -> Column:
    """About origin, by default the centroid."""
    return _about(g, origin, lambda x, y, o: (o["x"] + (x - o["x"]) * sx, o["y"] + (y - o["y"]) * (sx if sy is None else sy)))


def rotated(g: Column, degrees: float, origin: Column | None = None) -> Column:
    """Counter-clockwise about origin, by default the centroid."""
    c, s = cos(radians(degrees)), sin(radians(degrees))
    return _about(g, origin, lambda x, y, o: (o["x"] + (x - o["x"]) * c - (y - o["y"]) * s, o["y"] + (x - o["x"]) * s + (y - o["y"]) * c))


def skewed(g: Column, x_degrees: float = 0.0, y_degrees: float = 0.0) -> Column:
    tx, ty = F.tan(F.radians(F.lit(float(x_degrees)))), F.tan(F.radians(F.lit(float(y_degrees))))
    return mapped(g, lambda x, y: (x + y * tx, y + x * ty))


def affine(g: Column, a: float, b: float, d: float, e: float, dx: float = 0.0, dy: float = 0.0) -> Column:
    return mapped(g, lambda x, y: (x * a + y * b + dx, x * d + y * e + dy))


def swapped(g: Column) -> Column:
    return mapped(g, lambda x, y: (y, x))


def rounded(g: Column, digits: int) -> Column:
    return mapped(g, lambda x, y: (F.round(x, digits), F.round(y, digits)))


def snapped_to_grid(g: Column, size: float) -> Column:
    return mapped(g, lambda x, y: (F.round(x / size) * size, F.round(y / size) * size))


def reversed_vertices(g: Column) -> Column:
    return geometry(g["type"], F.transform(g["parts"], F.reverse))


# Measures.


def centroid(g: Column) -> Column:
    """A point's own place; a line's by length, a polygon's by area; the mean of the vertices where those are 0. Parts weigh by their measure."""

    def one(p: Column) -> Column:
        """(weight, x * weight, y * weight) of a part."""

        def of_line(s: Column) -> Column:
            n = F.sqrt(F.pow(s["a"]["x"] - s["b"]["x"], 2) + F.pow(s["a"]["y"] - s["b"]["y"], 2))
            return F.struct(n.alias("w"), ((s["a"]["x"] + s["b"]["x"]) / 2 * n).alias("x"), ((s["a"]["y"] + s["b"]["y"]) / 2 * n).alias("y"))

        def of_ring(s: Column) -> Column:
            n = s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"]
            return F.struct((n * 3).alias("w"), ((s["a"]["x"] + s["b"]["x"]) * n).alias("x"), ((s["a"]["y"] + s["b"]["y"]) * n).alias("y"))

        zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
        add = lambda m, v: F.struct((m["w"] + v["w"]).alias("w"), (m["x"] + v["x"]).alias("x"), (m["y"] + v["y"]).alias("y"))
        # Worked out against the first vertex, so that places far from the origin lose no digits.
        near = F.transform(p, lambda v: F.struct((v["x"] - p[0]["x"]).alias("x"), (v["y"] - p[0]["y"]).alias("y")))
        ring = simple_kind(g) == "Polygon"
        sums = F.aggregate(F.transform(_sides(near), lambda s: F.when(ring, of_ring(s)).otherwise(of_line(s))), zero, add)

        def placed(total: Column) -> Column:
            mean = lambda k: _sum(F.transform(p, lambda v: v[k])) / F.size(p)
            place = lambda k: F.when(total["w"] != 0, total[k] / total["w"] + p[0][k]).otherwise(mean(k))
            return F.struct(F.when(ring, F.abs(total["w"]) / 6).otherwise(total["w"]).alias("w"), place("x").alias("x"), place("y").alias("y"))

        return let(sums, placed)

    def together(each: Column) -> Column:
        weight = _sum(F.transform(each, lambda c: c["w"]))
        by_weight = lambda k: _sum(F.transform(each, lambda c: c["w"] * c[k])) / weight
        plain = lambda k: _sum(F.transform(vertices(g), lambda v: v[k])) / F.size(vertices(g))
        place = lambda k: F.when(F.size(each) == 1, each[0][k]).when(weight != 0, by_weight(k)).otherwise(plain(k))
        return xy(place("x"), place("y"))

    return let(F.transform(g["parts"], one), together)


def intersects_bounds(g: Column, min_x: Column, min_y: Column, max_x: Column, max_y: Column) -> Column:
    return let(bounds(g), lambda b: (b["min_x"] <= max_x) & (b["max_x"] >= min_x) & (b["min_y"] <= max_y) & (b["max_y"] >= min_y))


def within_bounds(g: Column, min_x: Column, min_y: Column, max_x: Column, max_y: Column) -> Column:
    return let(bounds(g), lambda b: (b["min_x"] >= min_x) & (b["max_x"] <= max_x) & (b["min_y"] >= min_y) & (b["max_y"] <= max_y))


def envelope(g: Column) -> Column:
    return let(bounds(g), lambda b: rectangle(b["min_x"], b["min_y"], b["max_x"], b["max_y"]))


def distance(a: Column, b: Column) -> Column:
    """Between centroids."""
    return let(F.struct(centroid(a).alias("p"), centroid(b).alias("q")), lambda c: F.sqrt(F.pow(c["p"]["x"] - c["q"]["x"], 2) + F.pow(c["p"]["y"] - c["q"]["y"], 2)))


def signed_area(ring: Column) -> Column:
    return _twice_area(ring) / 2


def compactness(g: Column) -> Column:
    """Polsby-Popper: 4 pi area / perimeter ** 2."""
    n = length(g)
    return F.when(n > 0, area(g) * (4 * 3.141592653589793) / (n * n)).otherwise(F.lit(0.0))


def n_vertices(g: Column) -> Column:
    return F.size(vertices(g))


def segments(g: Column) -> Column:
    """Array of (a, b) of every part's sides."""
    return F.flatten(F.transform(g["parts"], _sides))


def longest_side(g: Column) -> Column:
    return F.array_max(F.transform(segments(g), lambda s: F.sqrt(F.pow(s["a"]["x"] - s["b"]["x"], 2) + F.pow(s["a"]["y"] - s["b"]["y"], 2))))


def azimuth(g: Column) -> Column:
    """Degrees clockwise from north, from the first vertex to the last."""
    v = vertices(g)
    a, b = F.element_at(v, 1), F.element_at(v, -1)
    return F.pmod(F.degrees(F.atan2(b["x"] - a["x"], b["y"] - a["y"])), F.lit(360.0))


def sinuosity(g: Column) -> Column:
    """Length over the distance of the ends."""
    v = vertices(g)
    a, b = F.element_at(v, 1), F.element_at(v, -1)
    d = F.sqrt(F.pow(a["x"] - b["x"], 2) + F.pow(a["y"] - b["y"], 2))
    return F.when(d > 0, length(g) / d)


# Predicates. A side's or vertex's touch counts; comparisons allow TOLERANCE.

TOLERANCE = 1e-9


def _cross(o: Column, a: Column, b: Column) -> Column:
    return (a["x"] - o["x"]) * (b["y"] - o["y"]) - (a["y"] - o["y"]) * (b["x"] - o["x"])


def _on(p: Column, s: Column) -> Column:
    a, b = s["a"], s["b"]
    t = TOLERANCE
    return (
        (F.abs(_cross(a, p, b)) <= t)
        & (p["x"] >= F.least(a["x"], b["x"]) - t) & (p["x"] <= F.greatest(a["x"], b["x"]) + t)
        & (p["y"] >= F.least(a["y"], b["y"]) - t) & (p["y"] <= F.greatest(a["y"], b["y"]) + t)
    )


def _meet(s: Column, t: Column) -> Column:
    """Whether two sides have a point in common."""
    one, two = _cross(s["a"], s["b"], t["a"]), _cross(s["a"], s["b"], t["b"])
    three, four = _cross(t["a"], t["b"], s["a"]), _cross(t["a"], t["b"], s["b"])
    apart = lambda x, y: ((x > TOLERANCE) & (y < -TOLERANCE)) | ((x < -TOLERANCE) & (y > TOLERANCE))
    return (apart(one, two) & apart(three, four)) | _on(t["a"], s) | _on(t["b"], s) | _on(s["a"], t) | _on(s["b"], t)


def _in_ring(p: Column, ring: Column) -> Column:
    over = lambda s: ((s["a"]["y"] > p["y"]) != (s["b"]["y"] > p["y"])) & (p["x"] <= (s["b"]["x"] - s["a"]["x"]) * (p["y"] - s["a"]["y"]) / (s["b"]["y"] - s["a"]["y"]) + s["a"]["x"])
    return F.exists(_sides(ring), lambda s: _on(p, s)) | (F.size(F.filter(_sides(ring), over)) % 2 == 1)


def intersects(a: Column, b: Column) -> Column:
    ka, kb = simple_kind(a), simple_kind(b)
    cross = lambda p, q: F.exists(_sides(p), lambda s: F.exists(_sides(q), lambda t: _meet(s, t)))

    def pair(p: Column, q: Column) -> Column:
        return (
            F.when((ka == "Point") & (kb == "Point"), p[0] == q[0])
            .when((ka == "Point") & (kb == "LineString"), F.exists(_sides(q), lambda s: _on(p[0], s)))
            .when((ka == "LineString") & (kb == "Point"), F.exists(_sides(p), lambda s: _on(q[0], s)))
            .when(ka == "Point", _in_ring(p[0], q))
            .when(kb == "Point", _in_ring(q[0], p))
            .when((ka == "LineString") & (kb == "LineString"), cross(p, q))
            .when(ka == "LineString", cross(p, q) | F.exists(p, lambda v: _in_ring(v, q)))
            .when(kb == "LineString", cross(p, q) | F.exists(q, lambda v: _in_ring(v, p)))
            .otherwise(cross(p, q) | _in_ring(p[0], q) | _in_ring(q[0], p))
        )

    return F.exists(a["parts"], lambda p: F.exists(b["parts"], lambda q: pair(p, q)))


def within(a: Column, b: Column) -> Column:
    """Whether every vertex of each part of a lies in one part of b."""
    ka, kb = simple_kind(a), simple_kind(b)

    def pair(p: Column, q: Column) -> Column:
        return (
            F.when(kb == "Polygon", F.forall(p, lambda v: _in_ring(v, q)))
            .when((ka == "Point") & (kb == "Point"), p[0] == q[0])
            .when((kb == "LineString") & (ka != "Polygon"), F.forall(p, lambda v: F.exists(_sides(q), lambda s: _on(v, s))))
            .otherwise(F.lit(False))
        )

    return F.forall(a["parts"], lambda p: F.exists(b["parts"], lambda q: pair(p, q)))


def contains(a: Column, b: Column) -> Column:
    return within(b, a)


def disjoint(a: Column, b: Column) -> Column:
    return ~intersects(a, b)


def equals(a: Column, b: Column) -> Column:
    return normalize(a).eqNullSafe(normalize(b))


def covers(a: Column, b: Column) -> Column:
    return contains(a, b) | equals(a, b)


def covered_by(a: Column, b: Column) -> Column:
    return covers(b, a)


PREDICATES = {"intersects": intersects, "within": within, "contains": contains, "disjoint": disjoint, "equals": equals, "covers": covers, "covered_by": covered_by}


def representative_point(g: Column) -> Column:
    """The centroid, or a polygon's first vertex if that lies outside."""
    outside = lambda at: (g["type"] == "Polygon") & ~within(at, g)
    return let(feature_to_point(g), lambda at: F.when(outside(at), point(vertices(g)[0]["x"], vertices(g)[0]["y"])).otherwise(at))


# Validity and repair.


def _consecutive_equal(part: Column) -> Column:
    return F.exists(_sides(part), lambda s: s["a"] == s["b"])


def _crosses_itself(part: Column, ring: Column) -> Column:
    """Whether two sides that aren't neighbours meet."""
    sides = F.transform(_sides(part), lambda s, i: F.struct(s["a"].alias("a"), s["b"].alias("b"), i.alias("i")))
    apart = lambda s, t, n: (t["i"] > s["i"] + 1) & ~(ring & (s["i"] == 0) & (t["i"] == n - 1))
    return let(sides, lambda all_: F.exists(all_, lambda s: F.exists(all_, lambda t: apart(s, t, F.size(all_)) & _meet(s, t))))


def _spikes(ring: Column, least: float) -> Column:
    """Whether a corner's angle is below least (radians)."""
    corners = F.transform(F.sequence(F.lit(0), F.size(ring) - 2), lambda i: F.struct(F.when(i == 0, F.element_at(ring, -2)).otherwise(F.get(ring, i - 1)).alias("p"), F.get(ring, i).alias("q"), F.get(ring, i + 1).alias("r")))

    def sharp(c: Column) -> Column:
        ax, ay, bx, by = c["p"]["x"] - c["q"]["x"], c["p"]["y"] - c["q"]["y"], c["r"]["x"] - c["q"]["x"], c["r"]["y"] - c["q"]["y"]
        n = F.sqrt((ax * ax + ay * ay) * (bx * bx + by * by))
        return (n > 0) & (F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ax * bx + ay * by) / n))) < least)

    return (F.size(ring) >= 4) & F.exists(corners, sharp)


def issues(g: Column, spike: float = 0.12) -> Column:
    """Names of what is wrong with any part: duplicate_vertices, insufficient_distinct_vertices, zero_length, zero_area, clockwise_exterior, self_intersection, narrow_spike."""
    k, n = simple_kind(g), normalize(g)["parts"]
    some = lambda test: F.exists(n, test)
    is_line, is_ring = k == "LineString", k == "Polygon"
    tests = [
        ("duplicate_vertices", F.when(g["type"] == "MultiPoint", F.size(F.array_distinct(vertices(g))) < F.size(vertices(g))).otherwise((k != "Point") & some(_consecutive_equal))),
        ("insufficient_distinct_vertices", (is_line & some(lambda p: F.size(F.array_distinct(p)) < 2)) | (is_ring & some(lambda p: F.size(F.array_distinct(p)) < 3))),
        ("zero_length", is_line & some(lambda p: _sum(F.transform(_sides(p), lambda s: F.abs(s["a"]["x"] - s["b"]["x"]) + F.abs(s["a"]["y"] - s["b"]["y"]))) == 0)),
        ("zero_area", is_ring & some(lambda p: _twice_area(p) == 0)),
        ("clockwise_exterior", is_ring & some(lambda p: _twice_area(p) < 0)),
        ("self_intersection", (k != "Point") & some(lambda p: (F.size(p) >= 4) & _crosses_itself(p, is_ring))),
        ("narrow_spike", is_ring & some(lambda p: _spikes(p, spike))),
    ]
    return F.filter(F.array(*[F.when(t, F.lit(name)) for name, t in tests]), lambda x: x.isNotNull())


def validity(g: Column) -> Column:
    """is_valid, issue_count and issues."""
    found = issues(g)
    return F.struct((F.size(found) == 0).alias("is_valid"), F.size(found).alias("issue_count"), found.alias("issues"))


def repair(g: Column) -> Column:
    """Without equal vertices in a row; rings closed and counter-clockwise."""
    lean = lambda p: F.filter(p, lambda v, i: (i == 0) | (v != F.get(p, i - 1)))
    ccw = lambda r: F.when(_twice_area(r) < 0, F.reverse(r)).otherwise(r)
    ring = simple_kind(g) == "Polygon"
    several = F.when(g["type"] == "MultiPoint", F.array_distinct(g["parts"])).otherwise(F.transform(g["parts"], lambda p: F.when(ring, ccw(closed(lean(p)))).otherwise(lean(p))))
    return geometry(g["type"], several)


# Constructions.


def convex_hull(g: Column) -> Column:
    """By the monotone chain; a point or line if the vertices are one or on a line."""

    def chain(points: Column) -> Column:
        def drop(s: Column, p: Column) -> Column:
            # Takes the last vertices off while they don't turn left; at most as many as there are.
            once = lambda t: F.when((F.size(t) >= 2) & (_cross(F.element_at(t, -2), F.element_at(t, -1), p) <= 0), F.slice(t, F.lit(1), F.size(t) - 1)).otherwise(t)
            return F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(s), F.lit(1))), s, lambda t, i: once(t))

        return F.aggregate(points, F.slice(points, 1, 0), lambda s, p: F.concat(drop(s, p), F.array(p)))

    def joined(c: Column) -> Column:
        ring = F.concat(F.slice(c["lower"], F.lit(1), F.size(c["lower"]) - 1), c["upper"])
        flat = F.array(F.array(c["lower"][0], F.element_at(c["lower"], -1)))
        return F.when(F.size(c["lower"]) == 1, geometry("Point", F.array(c["lower"]))).when(F.size(c["lower"]) + F.size(c["upper"]) <= 4, geometry("LineString", flat)).otherwise(geometry("Polygon", F.array(ring)))

    return let(F.array_sort(F.array_distinct(vertices(g))), lambda v: let(F.struct(chain(v).alias("lower"), chain(F.reverse(v)).alias("upper")), joined))


def _fixed(rows: list[list[float]]) -> Column:
    """Numbers known beforehand as an array of arrays, which the plan holds as one value."""
    return F.array(*[F.array(*[F.lit(float(v)) for v in r]) for r in rows])


def _turns(angles: list[float]) -> Column:
    """Cosine and sine of each angle."""
    return _fixed([[cos(a), sin(a)] for a in angles])


def circle(x: Column, y: Column, radius: Column | float, sides: int = 64) -> Column:
    """A polygon of so many sides about a place."""
    step = 2 * 3.141592653589793 / sides
    ring = F.transform(_turns([(i % sides) * step for i in range(sides + 1)]), lambda t: xy(x + t[0] * radius, y + t[1] * radius))
    return geometry("Polygon", F.array(ring))


def clipped(g: Column, min_x: float | Column, min_y: float | Column, max_x: float | Column, max_y: float | Column) -> Column:
    """A polygon's or ring set's parts inside a rectangle, by cutting at its four sides; null if nothing is left. Concave rings may keep a seam on the border."""

    def cut(ring: Column, inside, at) -> Column:
        def step(s: Column) -> Column:
            a, b = s["a"], s["b"]
            return F.when(inside(a) & inside(b), F.array(b)).when(inside(a), F.array(at(a, b))).when(inside(b), F.array(at(a, b), b)).otherwise(F.slice(F.array(a), 1, 0))

        kept = let(ring, lambda r: F.flatten(F.transform(_sides(r), step)))
        return let(kept, lambda k: F.when(F.size(k) > 0, closed(k)).otherwise(k))

    def on_x(v):
        return lambda a, b: xy(F.lit(v) if not isinstance(v, Column) else v, a["y"] + (b["y"] - a["y"]) * ((v - a["x"]) / (b["x"] - a["x"])))

    def on_y(v):
        return lambda a, b: xy(a["x"] + (b["x"] - a["x"]) * ((v - a["y"]) / (b["y"] - a["y"])), F.lit(v) if not isinstance(v, Column) else v)

    def ring(r: Column) -> Column:
        r = cut(r, lambda p: p["x"] >= min_x, on_x(min_x))
        r = cut(r, lambda p: p["x"] <= max_x, on_x(max_x))
        r = cut(r, lambda p: p["y"] >= min_y, on_y(min_y))
        return cut(r, lambda p: p["y"] <= max_y, on_y(max_y))

    return let(F.filter(F.transform(normalize(g)["parts"], ring), lambda r: F.size(r) >= 4), lambda left: F.when(F.size(left) > 0, geometry(g["type"], left)))


def interpolated(g: Column, share: float | Column) -> Column:
    """The place at a share of a line's length."""
    sides = F.transform(segments(g), lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), F.sqrt(F.pow(s["a"]["x"] - s["b"]["x"], 2) + F.pow(s["a"]["y"] - s["b"]["y"], 2)).alias("n")))
    goal = length(g) * share
    first = vertices(g)[0]
    start = F.struct(goal.alias("left"), first.alias("at"))

    def step(m: Column, s: Column) -> Column:
        t = F.least(F.lit(1.0), m["left"] / s["n"])
        here = xy(s["a"]["x"] + (s["b"]["x"] - s["a"]["x"]) * t, s["a"]["y"] + (s["b"]["y"] - s["a"]["y"]) * t)
        return F.when((m["left"] <= 0) | (s["n"] <= 0), m).otherwise(F.struct(F.greatest(F.lit(0.0), m["left"] - s["n"]).alias("left"), here.alias("at")))

    return geometry("Point", F.array(F.array(F.aggregate(sides, start, step)["at"])))


def located(g: Column, x: Column, y: Column) -> Column:
    """distance from a place to a line and measure, the length along it to the nearest point."""

    def near(s: Column) -> Column:
        dx, dy = s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]
        n2 = dx * dx + dy * dy
        t = F.when(n2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - s["a"]["x"]) * dx + (y - s["a"]["y"]) * dy) / n2))).otherwise(F.lit(0.0))
        d = F.sqrt(F.pow(x - s["a"]["x"] - t * dx, 2) + F.pow(y - s["a"]["y"] - t * dy, 2))
        return F.struct(d.alias("d"), (t * F.sqrt(n2)).alias("along"), F.sqrt(n2).alias("n"))

    start = F.struct(F.lit(float("inf")).alias("distance"), F.lit(0.0).alias("measure"), F.lit(0.0).alias("before"))

    def step(m: Column, s: Column) -> Column:
        better = s["d"] < m["distance"]
        return F.struct(F.when(better, s["d"]).otherwise(m["distance"]).alias("distance"), F.when(better, m["before"] + s["along"]).otherwise(m["measure"]).alias("measure"), (m["before"] + s["n"]).alias("before"))

    return F.aggregate(F.transform(segments(g), near), start, step, lambda m: F.struct(m["distance"], m["measure"]))


def densified(g: Column, most: float) -> Column:
    """With vertices put in, evenly, so that no side is longer than most."""

    def side(s: Column) -> Column:
        n = F.greatest(F.lit(1), F.ceil(F.sqrt(F.pow(s["a"]["x"] - s["b"]["x"], 2) + F.pow(s["a"]["y"] - s["b"]["y"], 2)) / most)).cast("int")
        return F.transform(F.sequence(F.lit(1), n), lambda i: xy(s["a"]["x"] + (s["b"]["x"] - s["a"]["x"]) * i / n, s["a"]["y"] + (s["b"]["y"] - s["a"]["y"]) * i / n))

    return F.when(simple_kind(g) == "Point", g).otherwise(geometry(g["type"], F.transform(g["parts"], lambda p: F.concat(F.array(p[0]), F.flatten(F.transform(_sides(p), side))))))


# Conversions between kinds.


def forced(g: Column, type_: str) -> Column:
    """A simple geometry as its multi-part kind, or back if it has one part."""
    return geometry(type_, g["parts"])


def boundary(g: Column) -> Column:
    """A polygon's rings as lines; a line's ends as points; nothing for points."""
    ends = F.flatten(F.transform(g["parts"], lambda p: F.array(F.array(p[0]), F.array(F.element_at(p, -1)))))
    k = simple_kind(g)
    return F.when(k == "Polygon", geometry(F.when(F.size(g["parts"]) == 1, "LineString").otherwise("MultiLineString"), g["parts"])).when(k == "LineString", geometry("MultiPoint", ends))


def exterior_ring(g: Column) -> Column:
    """A polygon's ring as a line (feature_to_line); null for others. Holes aren't held, so there are no interior rings."""
    return F.when(g["type"] == "Polygon", geometry("LineString", g["parts"]))


def line_to_polygon(g: Column) -> Column:
    return F.when(simple_kind(g) == "LineString", geometry("Polygon", F.transform(g["parts"], closed)))


def feature_to_polygon(g: Column, radius: float = 0.0001) -> Column:
    """A circle about a point, a line closed, a polygon as it is."""
    v = vertices(g)[0]
    return F.when(g["type"] == "Point", circle(v["x"], v["y"], radius, 32)).when(g["type"] == "LineString", line_to_polygon(g)).otherwise(g)


def feature_to_point(g: Column) -> Column:
    return geometry("Point", F.array(F.array(centroid(g))))


def points_to_line(points: Column) -> Column:
    """A line through an array of points, in order."""
    return geometry("LineString", F.array(F.transform(points, lambda p: vertices(p)[0])))


def geometry_n(g: Column, n: int) -> Column:
    """Part n from 0, or null."""
    return F.get(parts(g), F.lit(n))


def n_parts(g: Column) -> Column:
    return F.size(g["parts"])


def is_empty(g: Column) -> Column:
    return g.isNull() | (F.size(vertices(g)) == 0)


def validity_reason(g: Column) -> Column:
    found = issues(g)
    return F.when(F.size(found) == 0, "Valid").otherwise(F.array_join(found, ", "))


def hashed(g: Column) -> Column:
    """A hash of the normal form, for finding equal geometries."""
    return F.sha2(F.to_json(normalize(g)), 256)


def canonical(g: Column) -> Column:
    """Rings counter-clockwise from their least vertex, lines from their lesser end, parts sorted."""

    def ring(r: Column) -> Column:
        open_ = F.slice(F.when(_twice_area(r) < 0, F.reverse(r)).otherwise(r), F.lit(1), F.size(r) - 1)
        at = F.array_position(open_, F.array_min(open_)).cast("int")
        turned = F.concat(F.slice(open_, at, F.size(open_)), F.slice(open_, F.lit(1), at - 1))
        return F.concat(turned, F.array(turned[0]))

    k = simple_kind(g)
    ways = lambda p: F.when(F.struct(F.element_at(p, -1)) < F.struct(p[0]), F.reverse(p)).otherwise(p)
    several = F.when(k == "Polygon", F.transform(normalize(g)["parts"], ring)).when(k == "LineString", F.transform(g["parts"], ways)).otherwise(g["parts"])
    return geometry(g["type"], F.array_sort(several))


def without_repeats(g: Column, tolerance: float = 0.0) -> Column:
    """Without vertices that lie within tolerance of the one kept before."""

    def step(kept: Column, v: Column) -> Column:
        last = F.element_at(kept, -1)
        near = F.sqrt(F.pow(last["x"] - v["x"], 2) + F.pow(last["y"] - v["y"], 2)) <= tolerance
        return F.when(near, kept).otherwise(F.concat(kept, F.array(v)))

    return geometry(g["type"], F.transform(g["parts"], lambda p: F.aggregate(F.slice(p, F.lit(2), F.size(p)), F.array(p[0]), step)))


def precision(g: Column, most: int = 12) -> Column:
    """The fewest decimals that all coordinates keep."""
    fits = lambda d: F.forall(vertices(g), lambda v: (F.abs(v["x"] - F.round(v["x"], d)) < 1e-12) & (F.abs(v["y"] - F.round(v["y"], d)) < 1e-12))
    out = F.lit(most)
    for d in range(most - 1, -1, -1):
        out = F.when(fits(d), F.lit(d)).otherwise(out)
    return out


def projective(g: Column, m: list[list[float]]) -> Column:
    """By a 3 x 3 matrix."""

    def go(x: Column, y: Column):
        w = x * m[2][0] + y * m[2][1] + m[2][2]
        return (x * m[0][0] + y * m[0][1] + m[0][2]) / w, (x * m[1][0] + y * m[1][1] + m[1][2]) / w

    return mapped(g, go)


def rubber_sheet(g: Column, controls: list[tuple[tuple[float, float], tuple[float, float]]]) -> Column:
    """Vertices shifted by the controls' shifts, weighted by inverse squared distance."""

    def go(x: Column, y: Column):
        w = [1 / (F.pow(x - a[0], 2) + F.pow(y - a[1], 2) + 1e-12) for a, _ in controls]
        total = sum(w, F.lit(0.0))
        return tuple(v + sum((wi * (b[k] - a[k]) for wi, (a, b) in zip(w, controls, strict=True)), F.lit(0.0)) / total for k, v in enumerate((x, y)))

    return mapped(g, go)


def smoothed(g: Column, rounds: int = 1) -> Column:
    """Corner cutting: each side gives its quarter points; lines keep their ends."""
    quarter = lambda s, t: xy(s["a"]["x"] + (s["b"]["x"] - s["a"]["x"]) * t, s["a"]["y"] + (s["b"]["y"] - s["a"]["y"]) * t)

    def once(p: Column, ring: Column) -> Column:
        cut = F.flatten(F.transform(_sides(p), lambda s: F.array(quarter(s, 0.25), quarter(s, 0.75))))
        return F.when(ring, F.concat(cut, F.array(cut[0]))).otherwise(F.concat(F.array(p[0]), cut, F.array(F.element_at(p, -1))))

    ring, out = simple_kind(g) == "Polygon", g
    for _ in range(rounds):
        out = F.when(simple_kind(g) == "Point", out).otherwise(geometry(g["type"], F.transform(out["parts"], lambda p: once(p, ring))))
    return out


# Along lines.


def substring(g: Column, start: float, end: float) -> Column:
    """The part of a line between two shares of its length."""
    v = segments(g)
    sides = F.transform(v, lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), F.sqrt(F.pow(s["a"]["x"] - s["b"]["x"], 2) + F.pow(s["a"]["y"] - s["b"]["y"], 2)).alias("n")))
    total = _sum(F.transform(sides, lambda s: s["n"]))
    lo, hi = total * start, total * end
    state = F.struct(F.lit(0.0).alias("at"), F.slice(F.array(vertices(g)[0]), 1, 0).alias("out"))

    def step(m: Column, s: Column) -> Column:
        past = m["at"] + s["n"]
        inside = (past > lo) & (m["at"] < hi)
        there = lambda d: xy(s["a"]["x"] + (s["b"]["x"] - s["a"]["x"]) * d / s["n"], s["a"]["y"] + (s["b"]["y"] - s["a"]["y"]) * d / s["n"])
        first, last = there(F.greatest(lo - m["at"], F.lit(0.0))), there(F.least(hi - m["at"], s["n"]))
        kept = F.when(F.size(m["out"]) == 0, F.array(first, last)).otherwise(F.concat(m["out"], F.array(last)))
        return F.struct(past.alias("at"), F.when(inside, kept).otherwise(m["out"]).alias("out"))

    return geometry("LineString", F.array(F.aggregate(sides, state, step)["out"]))


def located_share(g: Column, x: Column, y: Column) -> Column:
    """The share of a line's length at the point nearest to a place."""
    return F.when(length(g) > 0, located(g, x, y)["measure"] / length(g)).otherwise(F.lit(0.0))


def split_at(g: Column, share: float) -> Column:
    """The two lines before and after a share of the length."""
    return F.array(substring(g, 0.0, share), substring(g, share, 1.0))


def points_along(g: Column, count: int) -> Column:
    """count points at even shares, both ends included."""
    return F.array(*[interpolated(g, i / (count - 1) if count > 1 else 0.0) for i in range(count)])


def points_every(g: Column, interval: float) -> Column:
    """Points at multiples of an interval along a line, from 0."""
    return let(length(g), lambda n: F.transform(F.sequence(F.lit(0), F.floor(n / interval).cast("int")), lambda i: interpolated(g, i * interval / n)))


def at_measure(g: Column, measure: Column, start: float = 0.0, end: float | None = None) -> Column:
    """The place of a measure along a route whose measures run from start to end, by default its length."""
    span = (length(g) if end is None else F.lit(float(end))) - start
    return interpolated(g, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (measure - start) / span)))


def event_line(g: Column, lo: Column, hi: Column) -> Column:
    """The vertices of a route between two measures of its length: its ends there and the vertices between (dynamic segmentation)."""
    n = length(g)
    a, b = vertices(interpolated(g, lo / n))[0], vertices(interpolated(g, hi / n))[0]
    before = F.transform(vertices(g), lambda v: F.struct(v.alias("v"), located(g, v["x"], v["y"])["measure"].alias("m")))
    inner = F.transform(F.filter(before, lambda e: (e["m"] > lo) & (e["m"] < hi)), lambda e: e["v"])
    return geometry("LineString", F.array(F.concat(F.array(a), inner, F.array(b))))


def offset_line(g: Column, distance: float) -> Column:
    """Each side moved to the left by a distance (to the right if negative), as a line through the moved ends."""

    def moved(s: Column) -> Column:
        dx, dy = s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]
        n = F.sqrt(dx * dx + dy * dy)
        return F.array(xy(s["a"]["x"] - dy / n * distance, s["a"]["y"] + dx / n * distance), xy(s["b"]["x"] - dy / n * distance, s["b"]["y"] + dx / n * distance))

    return geometry(g["type"], F.transform(g["parts"], lambda p: F.array_distinct(F.flatten(F.transform(_sides(p), moved)))))


# Distances.


def _segment_distance(p: Column, s: Column) -> Column:
    dx, dy = s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]
    n2 = dx * dx + dy * dy
    t = F.when(n2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((p["x"] - s["a"]["x"]) * dx + (p["y"] - s["a"]["y"]) * dy) / n2))).otherwise(F.lit(0.0))
    return F.sqrt(F.pow(p["x"] - s["a"]["x"] - t * dx, 2) + F.pow(p["y"] - s["a"]["y"] - t * dy, 2))


def _all_sides(g: Column) -> Column:
    """Sides, or for points sides of no length."""
    return F.flatten(F.transform(g["parts"], lambda p: F.when(F.size(p) > 1, _sides(p)).otherwise(F.array(F.struct(p[0].alias("a"), p[0].alias("b"))))))


def least_distance(a: Column, b: Column) -> Column:
    """Between the nearest points of two geometries, 0 if they meet."""
    one = lambda x, y: F.array_min(F.transform(vertices(x), lambda v: F.array_min(F.transform(_all_sides(y), lambda s: _segment_distance(v, s)))))
    return F.when(intersects(a, b), F.lit(0.0)).otherwise(F.least(one(a, b), one(b, a)))


def dwithin(a: Column, b: Column, distance: float) -> Column:
    return least_distance(a, b) <= distance


def hausdorff(a: Column, b: Column) -> Column:
    """Of the vertices."""
    d = lambda p, q: F.sqrt(F.pow(p["x"] - q["x"], 2) + F.pow(p["y"] - q["y"], 2))
    one = lambda x, y: F.array_max(F.transform(vertices(x), lambda v: F.array_min(F.transform(vertices(y), lambda w: d(v, w)))))
    return F.greatest(one(a, b), one(b, a))


def frechet(a: Column, b: Column) -> Column:
    """Discrete Fréchet distance of the vertices in order, a row of the table at a time."""
    p, q = vertices(a), vertices(b)
    d = lambda v, w: F.sqrt(F.pow(v["x"] - w["x"], 2) + F.pow(v["y"] - w["y"], 2))

    def row(before: Column, v: Column) -> Column:
        def cell(out: Column, w: Column) -> Column:
            j = F.size(out)
            here = d(v, w)
            up, left, diagonal = F.get(before, j), F.element_at(out, -1), F.get(before, j - 1)
            reach = F.when(F.size(before) == 0, F.when(j == 0, here).otherwise(F.greatest(here, left))).when(j == 0, F.greatest(here, up)).otherwise(F.greatest(here, F.least(up, left, diagonal)))
            return F.concat(out, F.array(reach))

        return F.aggregate(q, F.array().cast("array<double>"), cell)

    return F.element_at(F.aggregate(p, F.array().cast("array<double>"), row), -1)


def touches(a: Column, b: Column) -> Column:
    """Whether they meet, but no inner vertex or middle of a side of one lies strictly within the other, nor do sides cross. Two points never touch."""
    ka, kb = simple_kind(a), simple_kind(b)
    inner = lambda x, y, kx, ky: ((ky == "Polygon") | ((ky == "LineString") & (kx != "Polygon"))) & F.exists(_probe(x), lambda v: _strictly_in(v, y))
    return intersects(a, b) & ~((ka == "Point") & (kb == "Point")) & ~inner(a, b, ka, kb) & ~inner(b, a, kb, ka) & ~_sides_cross(a, b)


def _probe(g: Column) -> Column:
    """Vertices (of lines without their ends), middles of sides and, for polygons, the centroid."""
    mids = F.transform(segments(g), lambda s: xy((s["a"]["x"] + s["b"]["x"]) / 2, (s["a"]["y"] + s["b"]["y"]) / 2))
    own = F.flatten(F.transform(g["parts"], lambda p: F.when(simple_kind(g) == "LineString", F.slice(p, F.lit(2), F.size(p) - 2)).otherwise(p)))
    return F.concat(own, mids, F.when(simple_kind(g) == "Polygon", F.array(centroid(g))).otherwise(F.slice(own, 1, 0)))


def _strictly_in(v: Column, g: Column) -> Column:
    ring = simple_kind(g) == "Polygon"
    return F.when(ring, F.exists(g["parts"], lambda p: _in_ring(v, p) & ~F.exists(_sides(p), lambda s: _on(v, s)))).when(
        simple_kind(g) == "LineString", F.exists(g["parts"], lambda p: F.exists(_sides(p), lambda s: _on(v, s)) & (v != p[0]) & (v != F.element_at(p, -1)))
    ).otherwise(F.exists(vertices(g), lambda w: v == w))


def _sides_cross(a: Column, b: Column) -> Column:
    """Whether two sides have an inner point of both in common."""

    def proper(s: Column, t: Column) -> Column:
        apart = lambda x, y: ((x > TOLERANCE) & (y < -TOLERANCE)) | ((x < -TOLERANCE) & (y > TOLERANCE))
        return apart(_cross(s["a"], s["b"], t["a"]), _cross(s["a"], s["b"], t["b"])) & apart(_cross(t["a"], t["b"], s["a"]), _cross(t["a"], t["b"], s["b"]))

    return F.exists(segments(a), lambda s: F.exists(segments(b), lambda t: proper(s, t)))


def crosses(a: Column, b: Column) -> Column:
    """A line that lies partly in and partly out of a polygon, or two lines whose sides cross."""
    ka, kb = simple_kind(a), simple_kind(b)
    part = lambda line_, area_: intersects(line_, area_) & ~within(line_, area_) & (_sides_cross(line_, area_) | F.exists(vertices(line_), lambda v: _strictly_in(v, area_)))
    return F.when((ka == "LineString") & (kb == "Polygon"), part(a, b)).when((ka == "Polygon") & (kb == "LineString"), part(b, a)).when((ka == "LineString") & (kb == "LineString"), _sides_cross(a, b)).otherwise(F.lit(False))


def overlaps(a: Column, b: Column) -> Column:
    """Geometries of one kind that share inner points, neither within the other."""
    inner = F.exists(_probe(a), lambda v: _strictly_in(v, b)) | F.exists(_probe(b), lambda v: _strictly_in(v, a)) | _sides_cross(a, b)
    return (simple_kind(a) == simple_kind(b)) & inner & ~within(a, b) & ~within(b, a)


def contains_properly(a: Column, b: Column) -> Column:
    """Whether all of b lies strictly within a."""
    return F.forall(vertices(b), lambda v: _strictly_in(v, a)) & ~_sides_cross(a, b)


PREDICATES |= {"touches": touches, "crosses": crosses, "overlaps": overlaps, "contains_properly": contains_properly}


# Figures.


def ellipse(x: Column, y: Column, major: float | Column, minor: float | Column, degrees: float = 0.0, sides: int = 72) -> Column:
    step, c, s = 2 * 3.141592653589793 / sides, cos(radians(degrees)), sin(radians(degrees))

    def at(t: Column) -> Column:
        u, v = t[0] * major, t[1] * minor
        return xy(x + u * c - v * s, y + u * s + v * c)

    return geometry("Polygon", F.array(F.transform(_turns([(i % sides) * step for i in range(sides + 1)]), at)))


def arc(x: Column, y: Column, radius: float | Column, start: float, end: float, sides: int = 32) -> Column:
    """A line along a circle from one angle to another (degrees, counter-clockwise from x)."""
    step = (end - start) / sides
    return geometry("LineString", F.array(F.transform(_turns([radians(i * step + start) for i in range(sides + 1)]), lambda t: xy(x + t[0] * radius, y + t[1] * radius))))


def spiral(x: Column, y: Column, start: float = 0.0, end: float = 1.0, turns: float = 1.0, sides: int = 64) -> Column:
    r = lambda i: i / sides * (end - start) + start
    return geometry("LineString", F.array(F.transform(F.sequence(F.lit(0), F.lit(sides)), lambda i: xy(x + F.cos(i / sides * (2 * 3.141592653589793 * turns)) * r(i), y + F.sin(i / sides * (2 * 3.141592653589793 * turns)) * r(i)))))


def bezier(controls: list[tuple[Column, Column]], sides: int = 64) -> Column:
    """A line along the curve of control points, by Bernstein's polynomials."""
    n = len(controls) - 1
    weights = [[(1 - i / sides) ** (n - k) * (i / sides) ** k * comb(n, k) for k in range(n + 1)] for i in range(sides + 1)]
    at = lambda w, d: sum((w[k] * p[d] for k, p in enumerate(controls)), F.lit(0.0))
    return geometry("LineString", F.array(F.transform(_fixed(weights), lambda w: xy(at(w, 0), at(w, 1)))))


def rings(x: Column, y: Column, distances: list[float], sides: int = 64) -> Column:
    """Circles at several distances (multi-ring buffers of a point)."""
    return F.array(*[circle(x, y, d, sides) for d in distances])


def bounding_circle(g: Column) -> Column:
    """x, y and radius of a circle about the bounds' centre through the farthest vertex."""
    far = lambda c: F.array_max(F.transform(vertices(g), lambda v: F.sqrt(F.pow(v["x"] - c["x"], 2) + F.pow(v["y"] - c["y"], 2))))
    middle = let(bounds(g), lambda b: xy((b["min_x"] + b["max_x"]) / 2, (b["min_y"] + b["max_y"]) / 2))
    return let(middle, lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y"), far(c).alias("radius")))


def rotated_rectangle(g: Column) -> Column:
    """The rectangle of least area about the hull, one of its sides along a side of the hull: area, width, height and degrees."""

    def box(h: Column, a: Column) -> Column:
        us = F.transform(vertices(h), lambda v: v["x"] * F.cos(a) + v["y"] * F.sin(a))
        vs = F.transform(vertices(h), lambda v: v["y"] * F.cos(a) - v["x"] * F.sin(a))
        size = F.struct((F.array_max(us) - F.array_min(us)).alias("w"), (F.array_max(vs) - F.array_min(vs)).alias("t"))
        return let(size, lambda z: F.struct((z["w"] * z["t"]).alias("area"), z["w"].alias("width"), z["t"].alias("height"), F.degrees(a).alias("degrees")))

    angle = lambda s: F.atan2(s["b"]["y"] - s["a"]["y"], s["b"]["x"] - s["a"]["x"])
    return let(convex_hull(g), lambda h: F.array_min(F.transform(F.transform(segments(h), angle), lambda a: box(h, a))))


# Places on the sphere.

EARTH_M = 6371008.8


def geodesic_bearing(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))), F.lit(360.0))


def _haversine_m(a: Column, b: Column) -> Column:
    h = F.pow(F.sin(F.radians(b["y"] - a["y"]) / 2), 2) + F.cos(F.radians(a["y"])) * F.cos(F.radians(b["y"])) * F.pow(F.sin(F.radians(b["x"] - a["x"]) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def geodesic_length(g: Column) -> Column:
    """Metres along lines of longitudes and latitudes."""
    return _sum(F.transform(segments(g), lambda s: _haversine_m(s["a"], s["b"])))


def geodesic_area(g: Column) -> Column:
    """Square metres of rings on the sphere."""
    side = lambda s: F.radians(s["b"]["x"] - s["a"]["x"]) * (2 + F.sin(F.radians(s["a"]["y"])) + F.sin(F.radians(s["b"]["y"])))
    return _sum(F.transform(g["parts"], lambda p: F.abs(_sum(F.transform(_sides(p), side))) * (EARTH_M * EARTH_M / 2)))


def destination(lon: Column, lat: Column, bearing: Column, metres: Column) -> Column:
    """x and y of the place at a bearing and distance on the sphere."""
    d, b, p = metres / EARTH_M, F.radians(bearing), F.radians(lat)
    to = F.asin(F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(b))
    return xy(lon + F.degrees(F.atan2(F.sin(b) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * F.sin(to))), F.degrees(to))


def geodesic_circle(lon: Column, lat: Column, metres: float, sides: int = 72) -> Column:
    at = lambda i: destination(lon, lat, (i % sides) * (360.0 / sides), F.lit(float(metres)))
    return geometry("Polygon", F.array(F.transform(F.sequence(F.lit(0), F.lit(sides)), at)))


_BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


def geohash(lon: Column, lat: Column, digits: int = 12) -> Column:
    """Interleaves the bits of longitude and latitude, five a digit."""
    bits = digits * 5
    nx, ny = (bits + 1) // 2, bits // 2
    x = F.least(F.floor((lon + 180) / 360 * float(1 << nx)), F.lit((1 << nx) - 1)).cast("long")
    y = F.least(F.floor((lat + 90) / 180 * float(1 << ny)), F.lit((1 << ny) - 1)).cast("long")
    out = []
    for d in range(digits):
        value = F.lit(0)
        for k in range(5):
            i = d * 5 + k
            source, left = (x, nx - 1 - i // 2) if i % 2 == 0 else (y, ny - 1 - i // 2)
            value = value * 2 + F.shiftright(source, left).bitwiseAND(F.lit(1)).cast("int")
        out.append(F.substring(F.lit(_BASE32), value + 1, F.lit(1)))
    return F.concat(*out)


def wkb(g: Column) -> Column:
    """Little-endian well-known binary of a geometry, by an Arrow-batched function."""

    @F.pandas_udf("binary")
    def go(kinds, several):
        import struct

        import pandas as pd

        def one(kind, rings_):
            pair = lambda p: struct.pack("<dd", p["x"], p["y"])
            seq = lambda r: struct.pack("<I", len(r)) + b"".join(map(pair, r))
            base = kind.removeprefix("Multi")
            simple = {"Point": lambda r: struct.pack("<BI", 1, 1) + pair(r[0]), "LineString": lambda r: struct.pack("<BI", 1, 2) + seq(r), "Polygon": lambda r: struct.pack("<BII", 1, 3, 1) + seq(r)}[base]
            if kind == base:
                return simple(rings_[0])
            return struct.pack("<BII", 1, {"Point": 4, "LineString": 5, "Polygon": 6}[base], len(rings_)) + b"".join(simple(r) for r in rings_)

        return pd.Series([None if k is None or p is None else one(k, p) for k, p in zip(kinds, several, strict=True)])

    return go(g["type"], g["parts"])


def from_wkb(data: Column) -> Column:
    """Geometry of little- or big-endian well-known binary; holes are dropped; null for what isn't one of the six kinds."""

    @F.pandas_udf(GEOMETRY)
    def go(blobs):
        import struct

        import pandas as pd

        names = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon"}

        def read(b, at):
            e = "<" if b[at] == 1 else ">"
            kind = struct.unpack_from(e + "I", b, at + 1)[0]
            at += 5

            def seq(at):
                n = struct.unpack_from(e + "I", b, at)[0]
                v = struct.unpack_from(f"{e}{2 * n}d", b, at + 4)
                return [{"x": v[i], "y": v[i + 1]} for i in range(0, 2 * n, 2)], at + 4 + 16 * n

            if kind == 1:
                x, y = struct.unpack_from(e + "dd", b, at)
                return kind, [[{"x": x, "y": y}]], at + 16
            if kind == 2:
                line_, at = seq(at)
                return kind, [line_], at
            n = struct.unpack_from(e + "I", b, at)[0]
            at += 4
            out = []
            for i in range(n):
                if kind == 3:
                    ring, at = seq(at)
                    out += [ring] if i == 0 else []
                else:
                    _, some, at = read(b, at)
                    out += some
            return kind, out, at

        rows = []
        for blob in blobs:
            try:
                kind, several, _ = read(bytes(blob), 0)
                rows.append({"type": names[kind], "parts": several})
            except (TypeError, KeyError, struct.error, IndexError):
                rows.append({"type": None, "parts": None})
        return pd.DataFrame(rows, columns=["type", "parts"])

    got = go(data)
    return F.when(got["type"].isNotNull(), got)


def simplified(g: Column, tolerance: float) -> Column:
    """Lines and rings without the vertices that lie within tolerance of the line through those kept (Douglas and Peucker), by an Arrow-batched function."""

    @F.pandas_udf("array<array<struct<x:double,y:double>>>")
    def go(several):
        import numpy as np
        import pandas as pd

        def one(line_):
            v = np.array([(p["x"], p["y"]) for p in line_])
            keep, todo = {0, len(v) - 1}, [(0, len(v) - 1)]
            while todo:
                a, b = todo.pop()
                if b - a < 2:
                    continue
                d = v[b] - v[a]
                n = np.hypot(*d)
                w = v[a + 1 : b] - v[a]
                far = np.abs(d[0] * w[:, 1] - d[1] * w[:, 0]) / n if n > 0 else np.hypot(w[:, 0], w[:, 1])
                k = int(far.argmax())
                if far[k] > tolerance:
                    m = a + 1 + k
                    keep.add(m)
                    todo += [(a, m), (m, b)]
            return [line_[i] for i in sorted(keep)]

        return pd.Series([None if s is None else [one(list(p)) for p in s] for s in several])

    return F.when(simple_kind(g) == "Point", g).otherwise(geometry(g["type"], go(g["parts"])))
