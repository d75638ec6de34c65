"""Formulas of single fields - utilities, hazards, farming, energy, traffic, property - as Columns on a row's values. Not rounded; tables are fixed values."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

def tier(value: Column, steps: list[tuple[float, str]], rest: str, strict: bool = False) -> Column:
    """The name of the first step that the value reaches (exceeds, if strict); steps from high to low."""
    out = None
    for least, name in steps:
        test = value > least if strict else value >= least
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(rest)


def weighted_score(weights: dict[str, float]) -> Column:
    """Sum of columns by weight; nulls count as 0. Siting scores: reforestation, energy, open space, archaeology, carbon storage."""
    return sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * w for c, w in weights.items()), F.lit(0.0))


# Water, coast and hazards.


def sewer_overflow(capacity: Column, dry: Column, wet: Column, storage: float = 0.0) -> Column:
    return F.greatest(F.lit(0.0), F.greatest(F.lit(0.0), dry + wet - capacity) - storage / 3600)


def wellhead_radius(days: Column, pumping: float = 500.0, porosity: float = 0.25, thickness: float = 20.0) -> Column:
    return F.sqrt(days * pumping / (pi * porosity * thickness))


def coastal_retreat(slope: Column, closure: Column, rise_per_year: float = 0.003, years: int = 50) -> Column:
    """Bruun's rule with the profile's width closure / slope (100 where slope is 0)."""
    width = F.when(slope != 0, closure / slope).otherwise(F.lit(100.0))
    return F.when(closure != 0, rise_per_year * years * (width + closure) / closure).otherwise(F.lit(0.0))


def tsunami_runup(slope: Column, wave: float = 5.0) -> Column:
    return (1 + 2 * F.sqrt(slope)) * wave


def tsunami_reach(slope: Column, wave: float = 5.0) -> Column:
    return F.when(slope > 0, tsunami_runup(slope, wave) / slope).otherwise(tsunami_runup(slope, wave) * 100)


def shaking_intensity(magnitude: Column, epicentral_km: Column, depth_km: float = 10.0) -> Column:
    return 2.085 + 1.428 * magnitude - 1.402 * F.log10(F.greatest(F.sqrt(epicentral_km * epicentral_km + depth_km * depth_km), F.lit(1.0)))


def surge_height(category: Column) -> Column:
    return F.when(category == 1, 1.5).when(category == 2, 2.5).when(category == 3, 4.0).when(category == 4, 5.5).when(category == 5, 7.0).otherwise(3.0)


def avalanche_start(slope: Column, least: float = 30.0) -> Column:
    return slope.between(least, 55.0)


def insurance_tier(score: Column) -> Column:
    return tier(score, [(0.7, "high"), (0.4, "medium")], "low")


def setback(setback_m: Column, erosion_rate: Column, years: int) -> Column:
    return setback_m + erosion_rate * years


def dune_loss(crest: Column, width: Column, surge: float = 2.0, wave: float = 3.0) -> Column:
    """Volume a metre: half the dune if the water reaches its crest, else a part of its width."""
    reach = surge + wave * 0.5
    return F.when(F.lit(reach) >= crest, width * crest * 0.5).otherwise(width * reach * 0.3)


def nourishment_volume(length: Column, width: float = 30.0, berm: float = 2.0, overfill: float = 1.3) -> Column:
    return length * (width * berm / 2 * overfill)


def pandemic_level(rate: Column, threshold: float = 100.0) -> Column:
    return tier(rate, [(threshold * 3, "critical"), (threshold, "high"), (threshold * 0.5, "moderate")], "low")


def release_concentration(distance: Column, rate: float = 1e6, wind: float = 5.0) -> Column:
    sy, sz = distance * 0.22 / F.sqrt(1 + distance * 0.0001), distance * 0.2
    return F.when((sy > 0) & (sz > 0), rate / (2 * pi * sy * sz * wind)).otherwise(F.lit(0.0))


def subsidence_category(rate: Column, threshold: float = 20.0) -> Column:
    return tier(rate, [(threshold * 2, "critical"), (threshold, "warning")], "stable", strict=True)


def dam_alert(pressure: Column, displacement: Column, pressure_limit: float = 200.0, displacement_limit: float = 50.0) -> Column:
    return (pressure > pressure_limit) | (displacement > displacement_limit)


# Farming, forests and cities.


def crop_yield(ndvi: Column, linear: bool = True) -> Column:
    return F.greatest(F.lit(0.0), ndvi * 12 - 2) if linear else F.greatest(F.lit(0.0), ndvi * 10)


def application_rate(nitrogen: Column, target: float = 150.0) -> Column:
    return F.greatest(F.lit(0.0), target - nitrogen)


def irrigate(moisture: Column, et_per_day: float = 5.0) -> Column:
    """Whether the soil's water lasts less than three days."""
    return moisture / et_per_day < 3


def timber_volume(dbh_cm: Column, height: Column, form: float = 0.45) -> Column:
    return F.pow(dbh_cm / 100, 2) * (pi / 4) * height * form


def canopy_share(canopy: Column, area: Column) -> Column:
    return F.when(area != 0, canopy / area * 100).otherwise(F.lit(0.0))


def cool_roof_savings(roof_m2: Column, albedo: float = 0.4, factor: float = 0.3) -> Column:
    return roof_m2 * (albedo * factor * 10)


def efficiency_score(eui: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - (eui - 50) * 0.5))


def efficiency_grade(eui: Column) -> Column:
    return tier(efficiency_score(eui), [(80, "A"), (60, "B"), (40, "C"), (20, "D")], "E")


def assessed_value(land_per_m2: Column, area: Column, improvements: Column, ratio: float = 0.85) -> Column:
    return (land_per_m2 * area + improvements) * ratio


def growth_status(density: Column, threshold: float = 500.0) -> Column:
    return tier(density, [(threshold, "urban")], "rural")


def at_growth_boundary(density: Column, threshold: float = 500.0) -> Column:
    return F.abs(density - threshold) < threshold * 0.3


def traffic_stress(speed: Column, lanes: Column, bike_lane: Column) -> Column:
    """Level 1 (low) to 4 of a street for cyclists."""
    return F.when(bike_lane & (speed <= 40) & (lanes <= 2), 1).when((speed <= 40) | (bike_lane & (speed <= 50)), 2).when(speed <= 60, 3).otherwise(4)


def sidewalk_rating(condition: Column) -> Column:
    return tier(condition, [(70, "good"), (40, "fair")], "poor")


def hydrant_color(gpm: Column) -> Column:
    return F.when(gpm < 500, "red").when(gpm < 1000, "orange").when(gpm < 1500, "green").otherwise("blue")


def overdue(last: Column, now: Column, days: int) -> Column:
    """Whether an inspection is more than so many days ago (manholes, hydrants); times in seconds."""
    return (now - last) / 86400 > days


def ping_status(age_s: Column, stale: float = 300.0) -> Column:
    return F.when(age_s > stale, "stale").otherwise("active")


def duct_fill(cable_mm: Column, duct_mm: Column) -> Column:
    return F.pow(cable_mm / duct_mm, 2) * 100


def wetland(soil: Column, vegetation: Column, hydrology: Column) -> Column:
    return soil & vegetation & hydrology


# Energy and signals.


def solar_output(area: Column, irradiance: float = 1500.0, efficiency: float = 0.2) -> Column:
    return area * irradiance * efficiency


def wind_at_height(speed: Column, measured: Column, hub: float = 80.0, roughness: float = 0.03) -> Column:
    """By the logarithmic profile; as measured below the roughness length."""
    return F.when(measured > roughness, speed * F.log(F.lit(hub / roughness)) / F.log(measured / roughness)).otherwise(speed)


def tidal_power(speed: Column, rotor: Column) -> Column:
    return F.pow(speed, 3) * rotor * (0.5 * 1025 * 0.35 / 1000)


def geothermal_score(gradient: Column, flow: Column) -> Column:
    return gradient * 0.5 + flow * 0.5


def link_budget(tx: Column, tx_gain: Column, rx_gain: Column, loss: Column, cable: float = 2.0, sensitivity: float = -90.0) -> Column:
    """eirp, received and fade_margin."""
    eirp = tx + tx_gain - cable
    return F.struct(eirp.alias("eirp"), (eirp - loss + rx_gain).alias("received"), (eirp - loss + rx_gain - sensitivity).alias("fade_margin"))


def radar_area(range_km: Column, beam_deg: float = 360.0) -> Column:
    return range_km * range_km * (pi * beam_deg / 360)


def allocation(supply: int, population: Column, total: Column) -> Column:
    """Whole units of a supply by share of the population."""
    return F.when(total > 0, F.floor(population * supply / total)).otherwise(F.lit(0))


def trade_pull(volume: Column, distance: Column) -> Column:
    return volume / (distance * distance + 1)


def station_priority(area: Column, population: Column, risk: Column) -> Column:
    return area * 0.4 + population * 0.3 + risk * 0.3


def seismic_lines(width: Column, height: Column, line: float = 200.0, receiver: float = 25.0) -> Column:
    """n_lines and receivers_per_line over an area."""
    return F.struct((F.floor(width / line) + 1).alias("n_lines"), (F.floor(height / receiver) + 1).alias("receivers_per_line"))
