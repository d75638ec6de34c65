"""Distance, decay, interaction and accessibility equations as Columns; all of them stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0088


def euclidean(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = EARTH_RADIUS_KM) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(0.0), 1 - a))) * (2 * radius)


def power_decay(d: Column, scale: float = 1.0, power: float = 2.0) -> Column:
    return 1 / F.pow(1 + d / scale, F.lit(power))


def exponential_decay(d: Column, rate: float = 1.0) -> Column:
    return F.exp(d * -rate)


def gaussian_decay(d: Column, sigma: float = 1.0) -> Column:
    return F.exp(-(d * d) / (2 * sigma * sigma))


DECAYS = {"power": power_decay, "exponential": exponential_decay, "gaussian": gaussian_decay}


def influence(weight: Column, d: Column, scale: float = 1.0, power: float = 2.0) -> Column:
    return weight * power_decay(d, scale, power)


def interaction(w1: Column, w2: Column, d: Column, scale: float = 1.0, power: float = 2.0) -> Column:
    return w1 * w2 * power_decay(d, scale, power)


def gravity(m1: Column, m2: Column, cost: Column, alpha: float = 1.0, beta: float = 1.0, gamma: float = 2.0, k: float = 1.0) -> Column:
    return k * F.pow(m1, F.lit(alpha)) * F.pow(m2, F.lit(beta)) / F.pow(cost, F.lit(gamma))


def logistic(x: Column) -> Column:
    """Stable on both sides of 0."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def corridor_strength(weight: Column, length: Column, d: Column, scale: float = 1.0, power: float = 2.0) -> Column:
    return weight * F.log1p(length) * power_decay(d, scale, power)


def area_similarity(a: Column, b: Column, d: Column, scale: float = 1.0, power: float = 1.0) -> Column:
    ratio = F.when((a == 0) & (b == 0), F.lit(1.0)).otherwise(F.least(a, b) / F.greatest(a, b))
    return ratio * power_decay(d, scale, power)


def bearing(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Degrees clockwise from north, 0 up to 360."""
    return F.pmod(F.degrees(F.atan2(x2 - x1, y2 - y1)), F.lit(360.0))


def alignment(x1: Column, y1: Column, x2: Column, y2: Column, preferred: float) -> Column:
    return F.cos(F.radians(bearing(x1, y1, x2, y2) - preferred))


def capacity_stress(load: Column, capacity: Column, power: float = 2.0) -> Column:
    return F.when(capacity > 0, F.pow(load / capacity, F.lit(power))).otherwise(F.lit(0.0))


def service_deficit(demand: Column, delivered: Column) -> Column:
    return F.when(demand > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (demand - delivered) / demand))).otherwise(F.lit(0.0))


def headloss(length: Column, flow: Column, diameter: Column, roughness: float = 130.0) -> Column:
    return 10.67 * length * F.pow(flow / roughness, F.lit(1.852)) / F.pow(diameter, F.lit(4.87))


def failure_rate(base: Column, age: Column, aging: float = 0.03) -> Column:
    return base * F.exp(age * aging)


def accessibility(supplies: Column, costs: Column, decay: str = "power", **options: float) -> Column:
    """Sum of supply times decayed cost over two arrays of one length."""
    terms = F.zip_with(supplies, costs, lambda s, c: s * DECAYS[decay](c, **options))
    return F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)
