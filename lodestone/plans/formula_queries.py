"""Queries on formulas: a row for each part, line or customer and a column for each formula, with the same formula in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import domain, environment, imagery, survey
from lodestone.plans.catalog import Tables, _QUERIES, _SQL

c, lit = F.col, F.lit
#: Parts with p_size as s (1 to 50), p_retailprice as r (900 to 2,000), a share q (0 to 1) and a key.
_PARTS = "x AS (SELECT p_partkey AS id, p_size::DOUBLE AS s, p_retailprice AS r, p_size / 50.0::DOUBLE AS q, p_brand AS b FROM part)"


def _parts(t: Tables):
    return t.part.select(c("p_partkey").alias("id"), c("p_size").cast("double").alias("s"), c("p_retailprice").alias("r"), (c("p_size") / lit(50.0)).alias("q"), c("p_brand").alias("b"))


def formulas(name: str, **columns) -> None:
    """Registers a query of one row a part; columns: name to (a function of s, r and q, SQL)."""
    _QUERIES[name] = lambda spark, folder: _parts(Tables(spark, folder)).select("id", *[v(c("s"), c("r"), c("q")).alias(k) for k, (v, _) in columns.items()])
    _SQL[name] = f"WITH {_PARTS} SELECT id, " + ", ".join(f"{sql} AS {k}" for k, (_, sql) in columns.items()) + " FROM x"


formulas(
    "formulas_water",
    runoff=(lambda s, r, q: environment.curve_number_runoff(s / 10, 40 + s), "CASE WHEN s / 10 - 0.2::DOUBLE * (1000 / (40 + s) - 10) <= 0 THEN 0 ELSE pow(s / 10 - 0.2::DOUBLE * (1000 / (40 + s) - 10), 2) / (s / 10 - 0.2::DOUBLE * (1000 / (40 + s) - 10) + (1000 / (40 + s) - 10)) END"),
    volume=(lambda s, r, q: environment.runoff_volume(r / 10, r, lit(80.0)), "r * CASE WHEN r / 254 <= 0.5::DOUBLE THEN 0 ELSE pow(r / 254 - 0.5::DOUBLE, 2) / (r / 254 + 2) END * 25.4::DOUBLE / 1000"),
    practice=(lambda s, r, q: environment.practice_size(s, r, kind="swale")["surface_area"], "r * s / 1000 * 0.9::DOUBLE * 0.9::DOUBLE / 0.6::DOUBLE"),
    erosion=(lambda s, r, q: environment.erosion(s, q, lit(1.5), q, lit(0.5)), "s * q * 1.5::DOUBLE * q * 0.5::DOUBLE"),
    overflow=(lambda s, r, q: domain.sewer_overflow(lit(1000.0), r / 2, r / 2, 3600.0), "greatest(0, greatest(0, r - 1000) - 1)"),
    wellhead=(lambda s, r, q: domain.wellhead_radius(s), "sqrt(s * 500 / (pi() * 0.25::DOUBLE * 20))"),
    pipe=(lambda s, r, q: environment.pipe_diameter(q), "sqrt(4 * (q / 1.5::DOUBLE) / pi())"),
    flooded=(lambda s, r, q: environment.flooded(s, 20.0), "(s <= 20)::INTEGER"),
    demand=(lambda s, r, q: environment.land_use_demand(F.when(s > 25, "Residential").otherwise("forest"), r), "r * CASE WHEN s > 25 THEN 0.0005::DOUBLE ELSE 0.0002::DOUBLE END"),
    priority=(lambda s, r, q: domain.station_priority(s, r, q), "0.4::DOUBLE * s + 0.3::DOUBLE * r + 0.3::DOUBLE * q"),
)

formulas(
    "formulas_hazards",
    retreat=(lambda s, r, q: domain.coastal_retreat(q / 10, lit(8.0)), "0.15::DOUBLE * (8 / (q / 10) + 8) / 8"),
    runup=(lambda s, r, q: domain.tsunami_runup(q), "5 * (1 + 2 * sqrt(q))"),
    reach=(lambda s, r, q: domain.tsunami_reach(q), "5 * (1 + 2 * sqrt(q)) / q"),
    shaking=(lambda s, r, q: domain.shaking_intensity(lit(6.0), s), "2.085::DOUBLE + 1.428::DOUBLE * 6 - 1.402::DOUBLE * log10(sqrt(s * s + 100))"),
    surge=(lambda s, r, q: domain.surge_height(s % 6), "CASE s % 6 WHEN 1 THEN 1.5 WHEN 2 THEN 2.5 WHEN 3 THEN 4.0 WHEN 4 THEN 5.5 WHEN 5 THEN 7.0 ELSE 3.0 END::DOUBLE"),
    avalanche=(lambda s, r, q: domain.avalanche_start(s), "s BETWEEN 30 AND 55"),
    insurance=(lambda s, r, q: domain.insurance_tier(q), "CASE WHEN q >= 0.7 THEN 'high' WHEN q >= 0.4 THEN 'medium' ELSE 'low' END"),
    setback=(lambda s, r, q: domain.setback(s, q, 30), "s + q * 30"),
    dune=(lambda s, r, q: domain.dune_loss(s / 5, r), "CASE WHEN 3.5 >= s / 5 THEN r * (s / 5) * 0.5 ELSE r * 3.5::DOUBLE * 0.3::DOUBLE END"),
    nourishment=(lambda s, r, q: domain.nourishment_volume(r), "r * 39"),
    pandemic=(lambda s, r, q: domain.pandemic_level(s * 8), "CASE WHEN s * 8 >= 300 THEN 'critical' WHEN s * 8 >= 100 THEN 'high' WHEN s * 8 >= 50 THEN 'moderate' ELSE 'low' END"),
    release=(lambda s, r, q: domain.release_concentration(r), "1e6::DOUBLE / (2 * pi() * (0.22::DOUBLE * r / sqrt(1 + 0.0001::DOUBLE * r)) * (0.2::DOUBLE * r) * 5)"),
    subsidence=(lambda s, r, q: domain.subsidence_category(s), "CASE WHEN s > 40 THEN 'critical' WHEN s > 20 THEN 'warning' ELSE 'stable' END"),
    alert=(lambda s, r, q: domain.dam_alert(r / 8, s), "r / 8 > 200 OR s > 50"),
    plume=(lambda s, r, q: environment.plume_concentration(lit(5.0), lit(3.0), r, "C"), "5 / (2 * pi() * (0.11::DOUBLE * r) * (0.08::DOUBLE * r) * 3)"),
    blast=(lambda s, r, q: environment.blast_radius(r, "evacuation"), "45 * pow(r, 1 / 3.0::DOUBLE)"),
    noise=(lambda s, r, q: environment.noise_level(lit(100.0), r, 0.5), "100 - (20 * log10(r) + 11) - 0.005::DOUBLE * r / 1000 - (0.5::DOUBLE * 4.8::DOUBLE - (2 + 0.5::DOUBLE * 14.4::DOUBLE) * (r / 1000))"),
    airport=(lambda s, r, q: environment.airport_noise(s, r), "10 * log10(s) + 65 - 20 * log10(r / 100)"),
)

formulas(
    "formulas_cities",
    yield_=(lambda s, r, q: domain.crop_yield(q), "greatest(0, 12 * q - 2)"),
    rate=(lambda s, r, q: domain.application_rate(s * 4), "greatest(0, 150 - s * 4)"),
    irrigate=(lambda s, r, q: domain.irrigate(s), "s / 5 < 3"),
    timber=(lambda s, r, q: domain.timber_volume(s, lit(20.0)), "pi() / 4 * pow(s / 100, 2) * 20 * 0.45::DOUBLE"),
    canopy=(lambda s, r, q: domain.canopy_share(s, r), "s / r * 100"),
    roof=(lambda s, r, q: domain.cool_roof_savings(r), "r * 1.2::DOUBLE"),
    efficiency=(lambda s, r, q: domain.efficiency_score(s * 6), "greatest(0, least(100, 100 - (s * 6 - 50) * 0.5))"),
    grade=(lambda s, r, q: domain.efficiency_grade(s * 6), "CASE WHEN 100 - (s * 6 - 50) * 0.5 >= 80 THEN 'A' WHEN 100 - (s * 6 - 50) * 0.5 >= 60 THEN 'B' WHEN 100 - (s * 6 - 50) * 0.5 >= 40 THEN 'C' WHEN 100 - (s * 6 - 50) * 0.5 >= 20 THEN 'D' ELSE 'E' END"),
    assessed=(lambda s, r, q: domain.assessed_value(s, r, lit(1000.0)), "(s * r + 1000) * 0.85::DOUBLE"),
    growth=(lambda s, r, q: domain.growth_status(s * 20), "CASE WHEN s * 20 >= 500 THEN 'urban' ELSE 'rural' END"),
    boundary=(lambda s, r, q: domain.at_growth_boundary(s * 20), "abs(s * 20 - 500) < 150"),
    stress=(lambda s, r, q: domain.traffic_stress(s * 2, s % 4 + 1, s % 2 == 0), "CASE WHEN s % 2 = 0 AND s * 2 <= 40 AND s % 4 + 1 <= 2 THEN 1 WHEN s * 2 <= 40 OR (s % 2 = 0 AND s * 2 <= 50) THEN 2 WHEN s * 2 <= 60 THEN 3 ELSE 4 END"),
    sidewalk=(lambda s, r, q: domain.sidewalk_rating(s * 2), "CASE WHEN s * 2 >= 70 THEN 'good' WHEN s * 2 >= 40 THEN 'fair' ELSE 'poor' END"),
    hydrant=(lambda s, r, q: domain.hydrant_color(r), "CASE WHEN r < 500 THEN 'red' WHEN r < 1000 THEN 'orange' WHEN r < 1500 THEN 'green' ELSE 'blue' END"),
    overdue=(lambda s, r, q: domain.overdue(r * 100000, lit(2e8), 365), "(2e8::DOUBLE - r * 100000) / 86400 > 365"),
    ping=(lambda s, r, q: domain.ping_status(r / 4), "CASE WHEN r / 4 > 300 THEN 'stale' ELSE 'active' END"),
    fill=(lambda s, r, q: domain.duct_fill(s, lit(100.0)), "pow(s / 100, 2) * 100"),
    wetland=(lambda s, r, q: domain.wetland(s > 10, s < 40, s % 2 == 0), "s > 10 AND s < 40 AND s % 2 = 0"),
    sprawl=(lambda s, r, q: environment.sprawl_index(r * 3, r, q, s * 4), "25 * (least(r * 3 / 5000, 1) + least(r / 3000, 1) + least(q, 1) + least(s * 4 / 150, 1))"),
    siting=(lambda s, r, q: domain.weighted_score({"q": 0.6, "s": 0.4}), "0.6::DOUBLE * q + 0.4::DOUBLE * s"),
)

formulas(
    "formulas_energy",
    solar=(lambda s, r, q: domain.solar_output(r), "r * 300"),
    wind=(lambda s, r, q: domain.wind_at_height(s, lit(10.0)), "s * ln(80 / 0.03::DOUBLE) / ln(10 / 0.03::DOUBLE)"),
    tidal=(lambda s, r, q: domain.tidal_power(s / 10, lit(100.0)), "pow(s / 10, 3) * 100 * 0.5 * 1025 * 0.35::DOUBLE / 1000"),
    geothermal=(lambda s, r, q: domain.geothermal_score(s, r), "0.5 * s + 0.5 * r"),
    margin=(lambda s, r, q: domain.link_budget(s, lit(15.0), lit(3.0), r / 10)["fade_margin"], "s + 15 - 2 - r / 10 + 3 + 90"),
    radar=(lambda s, r, q: domain.radar_area(s, 90.0), "pi() * s * s * 0.25"),
    allocation=(lambda s, r, q: domain.allocation(1000, s, lit(500.0)), "floor(s * 1000 / 500)::BIGINT"),
    pull=(lambda s, r, q: domain.trade_pull(r, s), "r / (s * s + 1)"),
    lines=(lambda s, r, q: domain.seismic_lines(r, s * 10)["n_lines"], "floor(r / 200)::BIGINT + 1"),
    voltage=(lambda s, r, q: environment.voltage_drop(s, r, lit(0.5), 3), "s * (0.5 * r / 1000) * sqrt(3)"),
    loss=(lambda s, r, q: environment.path_loss(r, s), "69.55::DOUBLE + 26.16::DOUBLE * log10(r) - 13.82::DOUBLE * log10(30) - ((1.1::DOUBLE * log10(r) - 0.7::DOUBLE) * 1.5 - (1.56::DOUBLE * log10(r) - 0.8::DOUBLE)) + (44.9::DOUBLE - 6.55::DOUBLE * log10(30)) * log10(s)"),
    received=(lambda s, r, q: environment.received_power(r, s), "58 - (69.55::DOUBLE + 26.16::DOUBLE * log10(r) - 13.82::DOUBLE * log10(30) - ((1.1::DOUBLE * log10(r) - 0.7::DOUBLE) * 1.5 - (1.56::DOUBLE * log10(r) - 0.8::DOUBLE)) + (44.9::DOUBLE - 6.55::DOUBLE * log10(30)) * log10(s))"),
    radius=(lambda s, r, q: environment.coverage_radius(r), "greatest(0.01, least(100, pow(10, (158 - (69.55::DOUBLE + 26.16::DOUBLE * log10(r) - 13.82::DOUBLE * log10(30) - ((1.1::DOUBLE * log10(r) - 0.7::DOUBLE) * 1.5 - (1.56::DOUBLE * log10(r) - 0.8::DOUBLE)))) / (44.9::DOUBLE - 6.55::DOUBLE * log10(30)))))"),
    carbon=(lambda s, r, q: environment.carbon_stock(s, r)["co2_equivalent"], "s * r * 0.47::DOUBLE * 1.26::DOUBLE * 3.67::DOUBLE"),
    emission=(lambda s, r, q: environment.emission(F.when(s > 25, "rail_km").otherwise("other"), r), "r * CASE WHEN s > 25 THEN 0.041::DOUBLE ELSE 1 END"),
    degree_days=(lambda s, r, q: environment.growing_degree_days(s), "greatest(0, s - 10)"),
)

formulas(
    "formulas_survey",
    bearing=(lambda s, r, q: survey.bearing(lit(0.0), lit(0.0), s - 25, r - 1500), "((degrees(atan2(s - 25, r - 1500)) % 360) + 360) % 360"),
    at_x=(lambda s, r, q: survey.point_at(s, r, s * 7, q)["x"], "s + q * sin(radians(s * 7))"),
    closing=(lambda s, r, q: survey.misclosure(survey.traverse(s, r, F.array(F.struct((s * 7).alias("bearing"), q.alias("distance")), F.struct(lit(90.0).alias("bearing"), s.alias("distance"))))), "sqrt(pow(q * sin(radians(s * 7)) + s, 2) + pow(q * cos(radians(s * 7)) + s * cos(radians(90)), 2))"),
    chord=(lambda s, r, q: survey.curve(r, s)["chord_length"], "2 * r * sin(radians(s) / 2)"),
    tangent=(lambda s, r, q: survey.curve(r, s)["tangent_length"], "r * tan(radians(s) / 2)"),
    arc=(lambda s, r, q: survey.curve_from_arc(r, s)["arc_length"], "s"),
    far=(lambda s, r, q: survey.floor_area_ratio(r, s), "r / s"),
    coverage=(lambda s, r, q: survey.lot_coverage(s, r), "s / r * 100"),
    quadrant=(lambda s, r, q: survey.quadrant_bearing(F.concat(lit("S "), s.cast("int").cast("string"), lit("°30'15\" W"))), "180 + s + 30 / 60.0::DOUBLE + 15 / 3600.0::DOUBLE"),
    sphere=(lambda s, r, q: survey.sphere_volume(s), "4 / 3.0::DOUBLE * pi() * pow(s, 3)"),
    away=(lambda s, r, q: survey.distance_3d(s, r, q, lit(0.0), lit(0.0), lit(0.0)), "sqrt(s * s + r * r + q * q)"),
    shadow=(lambda s, r, q: survey.shadow_length(r, s), "r / tan(radians(s))"),
    overlap=(lambda s, r, q: survey.box_overlap(F.struct(lit(0.0).alias("x1"), lit(0.0).alias("y1"), lit(0.0).alias("z1"), s.alias("x2"), s.alias("y2"), s.alias("z2")), F.struct(lit(10.0).alias("x1"), lit(5.0).alias("y1"), lit(0.0).alias("z1"), lit(30.0).alias("x2"), lit(30.0).alias("y2"), lit(30.0).alias("z2"))), "greatest(0, least(s, 30) - 10) * greatest(0, least(s, 30) - 5) * least(s, 30)"),
)

formulas(
    "formulas_imagery",
    log=(lambda s, r, q: imagery.advanced(q, "log"), "ln(q)"),
    power=(lambda s, r, q: imagery.advanced(s, "power", 1.5), "pow(s, 1.5)"),
    sine=(lambda s, r, q: imagery.advanced(s, "sin"), "sin(s)"),
    ndvi=(lambda s, r, q: imagery.normalized_difference(r, s), "(r - s) / (r + s)"),
    brightness=(lambda s, r, q: imagery.tasseled_cap(s, r, q)["brightness"], "(s + r + q) / 3"),
    wetness=(lambda s, r, q: imagery.tasseled_cap(s, r, q)["wetness"], "q - r"),
    cover=(lambda s, r, q: imagery.land_cover(q), "CASE WHEN q < 0.2 THEN 'water' WHEN q < 0.5 THEN 'bare' WHEN q < 0.8 THEN 'vegetation' ELSE 'urban' END"),
    mask=(lambda s, r, q: imagery.mask(q, 0.5), "(q >= 0.5)::INTEGER"),
    level=(lambda s, r, q: imagery.level(s, lit(0.0), lit(50.0)), "CASE WHEN s <= 12.5 THEN 'low' WHEN s < 37.5 THEN 'medium' ELSE 'high' END"),
    lit_=(lambda s, r, q: imagery.shadow_corrected(s, 10.0), "greatest(s, 10)"),
    haze=(lambda s, r, q: imagery.haze_corrected(s, 0.5), "s - 0.5"),
    calibrated=(lambda s, r, q: imagery.calibrated(s, 2.0, 1.0), "s * 2 + 1"),
    canopy=(lambda s, r, q: imagery.canopy_height(s, lit(20.0)), "greatest(0, s - 20)"),
    stereo=(lambda s, r, q: imagery.stereo_elevation(s, r), "(s + r) / 2"),
    coherence=(lambda s, r, q: imagery.coherence(s, r), "1 / (1 + abs(s - r))"),
    heat=(lambda s, r, q: imagery.heat_load(s), "sqrt(abs(s) + 1)"),
    sediment=(lambda s, r, q: imagery.sediment_transport(s), "pow(s, 1.3::DOUBLE)"),
    radiation=(lambda s, r, q: imagery.surface_radiation(s), "s * 100 + 500"),
    point_radiation=(lambda s, r, q: imagery.point_radiation(s, r, q), "greatest(0, 1000 - abs(q) * 2 + (cos(s) + sin(r)) * 20)"),
    lidar=(lambda s, r, q: imagery.lidar_class(s), "CASE WHEN s < 2 THEN 'ground' WHEN s < 10 THEN 'canopy' ELSE 'structure' END"),
    share=(lambda s, r, q: imagery.unmixed([s, r / 40], {"a": [10.0, 30.0], "b": [40.0, 40.0]})["a"], "(1 / (sqrt(pow(s - 10, 2) + pow(r / 40 - 30, 2)) + 1e-6::DOUBLE)) / (1 / (sqrt(pow(s - 10, 2) + pow(r / 40 - 30, 2)) + 1e-6::DOUBLE) + 1 / (sqrt(pow(s - 40, 2) + pow(r / 40 - 40, 2)) + 1e-6::DOUBLE))"),
)
