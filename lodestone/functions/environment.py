"""Environmental and engineering formulas as Columns. Values are not rounded. Tables of coefficients are fixed values."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

from .equations import euclidean

#: Dispersion coefficients (horizontal, vertical) by stability class.
DISPERSION = {"A": (0.22, 0.2), "B": (0.16, 0.12), "C": (0.11, 0.08), "D": (0.08, 0.06), "E": (0.06, 0.03), "F": (0.04, 0.016)}
#: Depth of a practice in metres.
PRACTICE_DEPTH = {"retention": 1.5, "bioretention": 0.9, "swale": 0.6}
#: Water demand of an area unit by land use.
DEMAND_RATES = {"residential": 0.0005, "commercial": 0.0003, "industrial": 0.0008, "agricultural": 0.001, "open_space": 0.0001}
#: Emissions of a unit of an activity.
EMISSIONS = {"car_km": 0.21, "bus_km": 0.089, "rail_km": 0.041, "flight_km": 0.255, "electricity_kwh": 0.233, "gas_kwh": 0.203, "beef_kg": 27.0, "chicken_kg": 6.9}


def by_name(key: Column, table: dict[str, float], default: float) -> Column:
    """table's value for a name, or default."""
    out = F.lit(float(default))
    for k, v in table.items():
        out = F.when(key == k, F.lit(float(v))).otherwise(out)
    return out


def curve_number_runoff(rain: Column, curve: Column, ratio: float = 0.2) -> Column:
    """Inches of runoff; 0 up to the initial abstraction; null for a curve number outside 0 to 100."""
    s = 1000 / curve - 10
    net = rain - s * ratio
    return F.when((curve > 0) & (curve < 100), F.when(net <= 0, F.lit(0.0)).otherwise(net * net / (net + s)))


def runoff_volume(rain_mm: Column, area_m2: Column, curve: Column) -> Column:
    return area_m2 * curve_number_runoff(rain_mm / 25.4, curve) * 25.4 / 1000


def practice_size(storm_mm: Column, area_m2: Column, coefficient: float = 0.9, kind: str = "retention", capture: float = 0.9) -> Column:
    """runoff_volume, capture_volume and surface_area of a stormwater practice."""
    runoff = area_m2 * storm_mm / 1000 * coefficient
    return F.struct(runoff.alias("runoff_volume"), (runoff * capture).alias("capture_volume"), (runoff * capture / PRACTICE_DEPTH.get(kind, 1.0)).alias("surface_area"))


def erosion(r: Column, k: Column, ls: Column, c: Column, p: Column) -> Column:
    return r * k * ls * c * p


def weighted_factors(factors: dict[str, float], normalise: bool = False) -> Column:
    """Sum of columns by weight, or of weights' shares (landslide susceptibility, habitat suitability)."""
    total = sum(factors.values()) if normalise else 1.0
    return sum((F.col(c) * (w / total if total else 0.0) for c, w in factors.items()), F.lit(0.0))


def noise_level(power_db: Column, distance: Column, ground: float = 0.0, hertz: float = 1000.0) -> Column:
    """Decibels at a distance of 1 at least: spherical loss, air absorption, ground effect."""
    d = F.greatest(distance, F.lit(1.0))
    return power_db - (20 * F.log10(d) + 11) - (0.005 * hertz / 1000) * d / 1000 - (ground * 4.8 - (2 + ground * 14.4) * (d / 1000))


def airport_noise(operations: Column, distance: Column) -> Column:
    return 10 * F.log10(F.greatest(operations, F.lit(1.0))) + 65 - 20 * F.log10(F.greatest(distance, F.lit(100.0)) / 100)


def voltage_drop(amps: Column, length_m: Column, ohm_per_km: Column, phases: int = 1) -> Column:
    return amps * (ohm_per_km * length_m / 1000) * (3**0.5 if phases == 3 else 2.0)


def pipe_diameter(flow: Column, velocity: float = 1.5) -> Column:
    return F.sqrt(4 * (flow / velocity) / pi)


def plume_concentration(rate: Column, wind: Column, distance: Column, stability: str = "D") -> Column:
    """On the axis of a release at the ground; 0 at no distance."""
    a, b = DISPERSION.get(stability.upper(), DISPERSION["D"])
    return F.when((distance > 0) & (wind > 0), rate / (2 * pi * (distance * a) * (distance * b) * wind)).otherwise(F.lit(0.0))


def blast_radius(tnt_kg: Column, effect: str = "lethal") -> Column:
    return F.pow(tnt_kg, F.lit(1 / 3)) * {"lethal": 3.5, "severe_injury": 6.0, "glass_breakage": 22.0, "evacuation": 45.0}[effect]


def carbon_stock(tons_per_ha: Column, area_ha: Column, fraction: float = 0.47, below: float = 0.26) -> Column:
    """above_ground, below_ground, total and co2_equivalent."""
    above = tons_per_ha * area_ha * fraction
    return F.struct(above.alias("above_ground"), (above * below).alias("below_ground"), (above * (1 + below)).alias("total"), (above * (1 + below) * 3.67).alias("co2_equivalent"))


def sprawl_index(population: Column, employment: Column, centrality: Column, streets: Column) -> Column:
    cap = lambda c: F.least(c, F.lit(1.0))
    return (cap(population / 5000) + cap(employment / 3000) + cap(centrality) + cap(streets / 150)) * 25


def path_loss(mhz: Column, km: Column) -> Column:
    """Okumura-Hata, a small city, masts of 30 and 1.5 metres."""
    f, d = F.log10(mhz), F.log10(F.greatest(km, F.lit(0.001)))
    mobile = (1.1 * f - 0.7) * 1.5 - (1.56 * f - 0.8)
    hb = F.log10(F.lit(30.0))
    return 69.55 + 26.16 * f - 13.82 * hb - mobile + (44.9 - 6.55 * hb) * d


def received_power(mhz: Column, km: Column, tx_dbm: float = 43.0, tx_gain: float = 15.0, rx_gain: float = 0.0) -> Column:
    return F.when(km > 0, tx_dbm + tx_gain + rx_gain - path_loss(mhz, km)).otherwise(F.lit(tx_dbm + tx_gain))


def coverage_radius(mhz: Column, tx_dbm: float = 43.0, tx_gain: float = 15.0, sensitivity: float = -100.0) -> Column:
    """Kilometres at which the received power falls to the sensitivity, between 0.01 and 100."""
    one, per = path_loss(mhz, F.lit(1.0)), 44.9 - 6.55 * F.log10(F.lit(30.0))
    return F.greatest(F.lit(0.01), F.least(F.lit(100.0), F.pow(F.lit(10.0), (tx_dbm + tx_gain - sensitivity - one) / per)))


def land_use_demand(use: Column, area: Column) -> Column:
    return area * by_name(F.lower(use), DEMAND_RATES, 0.0002)


def emission(activity: Column, quantity: Column) -> Column:
    return quantity * by_name(activity, EMISSIONS, 1.0)


def flooded(elevation: Column, level: float, nodata: float = -9999.0) -> Column:
    """1 where the ground lies at the water's level or below (flood and sea-level inundation)."""
    return ((elevation != nodata) & (elevation <= level)).cast("int")


def solar_radiation(slope: Column, aspect: Column, latitude: float, day: int = 172) -> Column:
    """Watts a square metre at noon on a slope that faces aspect (degrees): solar constant by the cosine of the incidence."""
    declination = F.radians(F.lit(23.45) * F.sin(F.radians(F.lit(360 / 365 * (284 + day)))))
    lat, s, a = F.radians(F.lit(float(latitude))), F.radians(slope), F.radians(aspect)
    zenith = F.acos(F.sin(lat) * F.sin(declination) + F.cos(lat) * F.cos(declination))
    return 1367 * F.greatest(F.lit(0.0), F.cos(zenith) * F.cos(s) + F.sin(zenith) * F.sin(s) * F.cos(a - pi))


def growing_degree_days(temperature: Column, base: float = 10.0) -> Column:
    return F.greatest(F.lit(0.0), temperature - base)


def distance_level(x: Column, y: Column, sx: float, sy: float) -> Column:
    return euclidean(x, y, F.lit(sx), F.lit(sy))
