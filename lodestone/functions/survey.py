"""Coordinate geometry of surveys as Columns: bearings (degrees clockwise from north), traverses, curves, ratios."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F


def bearing(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.pmod(F.degrees(F.atan2(x2 - x1, y2 - y1)), F.lit(360.0))


def point_at(x: Column, y: Column, bearing_: Column, distance: Column) -> Column:
    """The place at a bearing and distance."""
    a = F.radians(bearing_)
    return F.struct((x + distance * F.sin(a)).alias("x"), (y + distance * F.cos(a)).alias("y"))


def traverse(x: Column, y: Column, legs: Column) -> Column:
    """The places that legs, an array of structs (bearing, distance), lead to, the start first."""
    start = F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))

    def step(path: Column, leg: Column) -> Column:
        last = F.element_at(path, -1)
        return F.concat(path, F.array(point_at(last["x"], last["y"], leg["bearing"], leg["distance"])))

    return F.aggregate(legs, F.array(start), step)


def misclosure(path: Column) -> Column:
    """The distance of a traverse's end from its start."""
    a, b = F.element_at(path, 1), F.element_at(path, -1)
    return F.sqrt(F.pow(a["x"] - b["x"], 2) + F.pow(a["y"] - b["y"], 2))


def curve(radius: Column, delta: Column) -> Column:
    """arc_length, chord_length, tangent_length, external and mid_ordinate of a circular curve of so many degrees."""
    d = F.radians(delta)
    return F.struct(
        (radius * d).alias("arc_length"), (2 * radius * F.sin(d / 2)).alias("chord_length"), (radius * F.tan(d / 2)).alias("tangent_length"),
        (radius * (1 / F.cos(d / 2) - 1)).alias("external"), (radius * (1 - F.cos(d / 2))).alias("mid_ordinate"),
    )


def curve_from_arc(radius: Column, arc: Column) -> Column:
    return curve(radius, arc / radius * (180 / pi))


def floor_area_ratio(floor: Column, lot: Column) -> Column:
    return F.when(lot > 0, floor / lot)


def lot_coverage(footprint: Column, lot: Column) -> Column:
    return F.when(lot > 0, footprint / lot * 100)


def quadrant_bearing(text: Column) -> Column:
    """Degrees of a bearing as in N 45°30'15" E; null for other text."""
    pattern = r"(?i)^\s*([NS])\s*(\d+(?:\.\d+)?)[°d ]\s*(\d+)?['m]?\s*(\d+)?[\"s]?\s*([EW])\s*$"
    part = lambda i: F.regexp_extract(text, pattern, i)
    number = lambda i: F.coalesce(part(i).try_cast("double"), F.lit(0.0))
    angle = number(2) + number(3) / 60 + number(4) / 3600
    ns, ew = F.upper(part(1)), F.upper(part(5))
    return F.when((ns == "N") & (ew == "E"), angle).when((ns == "S") & (ew == "E"), 180 - angle).when((ns == "S") & (ew == "W"), 180 + angle).when((ns == "N") & (ew == "W"), F.pmod(360 - angle, F.lit(360.0)))


def sphere_volume(radius: Column) -> Column:
    return F.pow(radius, 3) * (4 / 3 * pi)


def box_overlap(a: Column, b: Column) -> Column:
    """Volume that two boxes (structs x1, y1, z1, x2, y2, z2) have in common."""
    out = F.lit(1.0)
    for k in "xyz":
        out = out * F.greatest(F.lit(0.0), F.least(a[f"{k}2"], b[f"{k}2"]) - F.greatest(a[f"{k}1"], b[f"{k}1"]))
    return out


def distance_3d(x1: Column, y1: Column, z1: Column, x2: Column, y2: Column, z2: Column) -> Column:
    return F.sqrt(F.pow(x1 - x2, 2) + F.pow(y1 - y2, 2) + F.pow(z1 - z2, 2))


def shadow_length(height: Column, altitude: Column) -> Column:
    """Of an object under a sun so many degrees high, 0.1 at least."""
    return height / F.greatest(F.tan(F.radians(F.greatest(altitude, F.lit(0.1)))), F.lit(1e-6))
