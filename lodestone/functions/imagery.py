"""Pixel and point formulas of imagery as Columns, on bands held as columns of a table of cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ADVANCED = {
    "log": lambda v, p: F.log(F.greatest(v, F.lit(1e-9))), "exp": lambda v, p: F.exp(v), "power": lambda v, p: F.pow(v, F.lit(p)), "sqrt": lambda v, p: F.sqrt(F.greatest(v, F.lit(0.0))),
    "abs": lambda v, p: F.abs(v), "sin": lambda v, p: F.sin(v), "cos": lambda v, p: F.cos(v), "tan": lambda v, p: F.tan(v),
}


def advanced(value: Column, operation: str = "log", power: float = 2.0) -> Column:
    return ADVANCED[operation](value, power)


def normalized_difference(a: Column, b: Column) -> Column:
    """NDVI of near infrared and red, NDWI of green and near infrared, and so on; 0 where both are."""
    return F.when(a + b != 0, (a - b) / (a + b)).otherwise(F.lit(0.0))


def tasseled_cap(red: Column, nir: Column, green: Column) -> Column:
    """brightness, greenness and wetness."""
    return F.struct(((red + nir + green) / 3).alias("brightness"), (nir - red).alias("greenness"), (green - nir).alias("wetness"))


def land_cover(index: Column) -> Column:
    return F.when(index < 0.2, "water").when(index < 0.5, "bare").when(index < 0.8, "vegetation").otherwise("urban")


def mask(value: Column, threshold: float) -> Column:
    """1 from the threshold on: crops, impervious surface, buildings, roads, water, clouds."""
    return (value >= threshold).cast("int")


def level(value: Column, lo: Column, hi: Column) -> Column:
    """low, medium or high, cut at a quarter and three quarters of the range."""
    mid = (lo + hi) / 2
    return F.when(value <= lo + (mid - lo) / 2, "low").when(value < mid + (hi - mid) / 2, "medium").otherwise("high")


def shadow_corrected(value: Column, threshold: float) -> Column:
    return F.greatest(value, F.lit(threshold))


def haze_corrected(value: Column, haze: float) -> Column:
    return value - haze


def calibrated(value: Column, gain: float = 1.0, bias: float = 0.0) -> Column:
    return value * gain + bias


def canopy_height(surface: Column, terrain: Column) -> Column:
    return F.greatest(F.lit(0.0), surface - terrain)


def stereo_elevation(left: Column, right: Column) -> Column:
    return (left + right) / 2


def coherence(a: Column, b: Column) -> Column:
    return 1 / (1 + F.abs(a - b))


def heat_load(value: Column) -> Column:
    return F.sqrt(F.abs(value) + 1)


def sediment_transport(value: Column) -> Column:
    return F.pow(F.abs(value), F.lit(1.3))


def surface_radiation(value: Column) -> Column:
    return value * 100 + 500


def point_radiation(x: Column, y: Column, z: Column) -> Column:
    return F.greatest(F.lit(0.0), 1000 - F.abs(z) * 2 + (F.cos(x) + F.sin(y)) * 20)


def lidar_class(z: Column) -> Column:
    return F.when(z < 2, "ground").when(z < 10, "canopy").otherwise("structure")


def unmixed(pixel: list[Column], members: dict[str, list[float]]) -> Column:
    """Shares of end members by inverse distance of their signatures."""
    w = {k: 1 / (F.sqrt(sum((F.pow(p - v, 2) for p, v in zip(pixel, sig, strict=True)), F.lit(0.0))) + 1e-6) for k, sig in members.items()}
    total = sum(w.values(), F.lit(0.0))
    return F.struct(*[(v / total).alias(k) for k, v in w.items()])
