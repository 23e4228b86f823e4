"""Scores and decision rules as column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from furrow import dims
from furrow.functions import numeric as N
from furrow.functions import text as X


def _in(c: Column, names) -> Column:
    return c.isin(*names)


# ------------------------------------------------------------ suitability (0-100)
def weather_match(label: Column, temp: Column, rain: Column) -> Column:
    ideal_t, ideal_r = (F.lit(v) for v in dims.WEATHER_IDEAL_DEFAULT)
    for names, t, r in reversed(dims.WEATHER_IDEALS):
        ideal_t, ideal_r = F.when(_in(label, names), F.lit(t)).otherwise(ideal_t), F.when(_in(label, names), F.lit(r)).otherwise(ideal_r)
    a = F.greatest(F.lit(1.0) - F.abs(temp - ideal_t) / F.lit(25.0), F.lit(0.2))
    b = F.greatest(F.lit(1.0) - F.abs(rain - ideal_r) / F.lit(300.0), F.lit(0.2))
    return N.round_to(F.lit(0.5) * a + F.lit(0.5) * b, 2)


def soil_match(n: Column, p: Column, k: Column, ph: Column) -> Column:
    npk = F.when(n + p + k >= 80, F.lit(1.0)).otherwise(F.lit(0.7))
    ok = F.when(ph.between(5.5, 7.5), F.lit(1.0)).otherwise(F.lit(0.6))
    return N.round_to(F.lit(0.6) * npk + F.lit(0.4) * ok, 2)


def district_match(position: Column) -> Column:
    """Rank bucket of a crop in its district list (position from zero)."""
    return F.when(position < 3, F.lit(1.0)).when(position < 6, F.lit(0.8)).otherwise(F.lit(0.6))


def season_list(label: Column) -> Column:
    pairs = [x for k, v in dims.CROP_SEASONS.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), label), F.array(*[F.lit(s) for s in dims.FOREST_SEASONS]))


def in_season(label: Column, season: Column) -> Column:
    """Strict season membership; Zaid and Summer are the same season, whole year always fits."""
    asked = F.when(season == "Summer", F.lit("Zaid")).otherwise(season)
    return (asked == "Whole Year") | F.array_contains(season_list(label), asked)


def suitability(p_norm: Column, soil: Column, weather: Column, district: Column, season: Column, zone_ok: Column) -> dict[str, Column]:
    """Points of each part and the clipped total."""
    def points(c: Column, w: float) -> Column:
        return N.round_to(c * F.lit(w), 1)

    parts = {"forest_points": points(p_norm, 40.0), "soil_points": points(soil, 20.0), "weather_points": points(weather, 20.0),
             "district_points": points(district, 10.0), "season_points": points(season, 10.0)}
    total = parts["forest_points"] + parts["soil_points"] + parts["weather_points"] + parts["district_points"] + parts["season_points"]
    total = F.when(zone_ok, total).otherwise(total * F.lit(0.5))
    return {**parts, "suitability_score": N.round_to(N.clip(total, 10.0, 99.0), 1)}


# ------------------------------------------------------------- advice points
def evidence_points(years: Column, production: Column, matrix_score: Column, cuts: tuple[int, int, int] = (10, 5, 1),
                    much: int = 10000) -> Column:
    """Points from cultivation years and production; without a record, six times the matrix score."""
    strong = F.when(production > much, F.lit(25.0)).otherwise(F.lit(20.0))
    return (F.when(years.isNull(), N.round_to(F.coalesce(matrix_score, F.lit(0.5)) * F.lit(6.0), 1))
            .when(years >= cuts[0], strong).when(years >= cuts[1], F.lit(15.0)).when(years >= cuts[2], F.lit(8.0)).otherwise(F.lit(4.0)))


def soil_status(ph: Column, low: Column, high: Column) -> Column:
    return (F.when(ph.isNull(), "UNKNOWN").when(ph.between(low, high), "SUITABLE")
            .when(ph.between(low - F.lit(0.5), high + F.lit(0.5)), "PARTIALLY_SUITABLE").otherwise("UNSUITABLE"))


def soil_points(status: Column) -> Column:
    return F.when(status == "SUITABLE", F.lit(15.0)).when(status == "PARTIALLY_SUITABLE", F.lit(7.0)).otherwise(F.lit(0.0))


def water_status(mm: Column) -> Column:
    return F.when(mm.isNull(), "UNKNOWN").when(mm >= 800, "SUITABLE").when(mm >= 400, "LIMITED").otherwise("UNSUITABLE")


def water_points(status: Column) -> Column:
    return (F.when(status == "SUITABLE", F.lit(10.0)).when(status == "LIMITED", F.lit(6.0))
            .when(status == "UNSUITABLE", F.lit(2.0)).otherwise(F.lit(0.0)))


def rotation_points(previous: Column, crop: Column) -> Column:
    fam_a, fam_b = X.lookup(previous, dims.CROP_FAMILIES), X.lookup(crop, dims.CROP_FAMILIES)
    return (F.when(F.coalesce(previous, F.lit("")) == "", F.lit(0.0)).when(F.lower(previous) == F.lower(crop), F.lit(2.0))
            .when(F.coalesce(fam_a == fam_b, F.lit(False)), F.lit(5.0)).when(_in(previous, dims.LEGUME_CROPS), F.lit(15.0))
            .otherwise(F.lit(10.0)))


def model_points(confidence: Column, matrix_score: Column) -> Column:
    c = F.coalesce(F.nullif(confidence, F.lit(0.0)), F.nullif(matrix_score, F.lit(0.0)), F.lit(0.7))
    return F.least(F.lit(15.0), N.round_to(c * F.lit(15.0), 2))


def rotation_factor(previous: Column, crop: Column) -> Column:
    """Multiplier of the parameter table for repetition, family repetition and a legume after a cereal."""
    t = dict(dims.ROTATION_FACTORS)
    fam_a, fam_b = X.lookup(previous, dims.CROP_FAMILIES), X.lookup(crop, dims.CROP_FAMILIES)
    return (F.when(F.lower(previous) == F.lower(crop), F.lit(t["monoculture_repetition_penalty"]))
            .when(F.coalesce(fam_a == fam_b, F.lit(False)), F.lit(t["same_family_repetition_penalty"]))
            .when((fam_a == "Poaceae") & (fam_b == "Fabaceae"), F.lit(t["legume_rotation_bonus"])).otherwise(F.lit(1.0)))


# ---------------------------------------------------------------- zones and soil
def growable(crop: Column, zone: Column, ndvi: Column | None = None, moisture: Column | None = None) -> Column:
    """Struct of verdict and confidence of a crop in a climate zone."""
    name = X.key(crop)

    def lists(table: Mapping[str, list[str]]) -> Column:
        return F.try_element_at(F.create_map(*[x for z, v in table.items() for x in (F.lit(z), F.array(*[F.lit(c) for c in v]))]), zone)

    blocked = F.coalesce(F.array_contains(lists(dims.ZONE_BLOCKED), name), F.lit(False))
    listed = F.coalesce(F.array_contains(lists(dims.ZONE_ALLOWED), name), F.lit(True))
    thirsty = _in(name, dims.WATER_INTENSIVE_CROPS)
    dry = F.lit(False)
    if ndvi is not None:
        dry = dry | F.coalesce(ndvi < 0.15, F.lit(False))
    if moisture is not None:
        dry = dry | F.coalesce(moisture < 0.10, F.lit(False))

    def verdict(ok: bool, confidence: Column, why: str) -> Column:
        return F.struct(F.lit(ok).alias("growable"), confidence.alias("confidence"), F.lit(why).alias("why"))

    known = F.when(zone.isNotNull(), "high").otherwise("low")
    return (F.when(blocked, verdict(False, known, "BLOCKED_IN_ZONE")).when(~listed, verdict(False, F.lit("medium"), "NOT_TYPICAL"))
            .when(dry & thirsty, verdict(False, F.lit("high"), "TOO_DRY")).otherwise(verdict(True, known, "SUITABLE")))


# The limits of the soil rules below are fixed values.
def soil_type(ph: Column, clay: Column, sand: Column, carbon: Column, lat: Column, lon: Column) -> Column:
    """Soil type from measured properties; ordered rules, first that holds."""
    return (F.when((lat >= 28.5) & (clay < 25) & (sand < 50), "Mountain Soil")
            .when(sand > 68, F.when((lat > 24) & (lon < 76), "Desert Soil").otherwise("Sandy Soil"))
            .when((clay > 38) & ph.between(7.2, 8.8), "Black Soil").when((ph < 5.5) & (clay > 20), "Laterite Soil")
            .when((ph >= 7.0) & (clay < 30) & (lon > 78) & (lat < 18), "Coastal Alluvial Soil")
            .when(ph.between(5.5, 7.2) & clay.between(15, 35) & (carbon < 5), "Red Soil").otherwise("Alluvial Soil"))


def soil_type_by_place(lat: Column, lon: Column) -> Column:
    """Rough soil type when only coordinates are known."""
    return (F.when((lat >= 24) & lon.between(88, 97), "Alluvial Soil").when((lat >= 28) & ((lon < 80) | (lon > 88)), "Mountain Soil")
            .when(lat.between(22, 30) & lon.between(68, 77), "Desert Soil").when(lat.between(13, 22) & lon.between(73, 80), "Black Soil")
            .when((lon < 77) & (lat < 20), "Laterite Soil").when((lon > 79) & (lat < 18), "Coastal Alluvial Soil").otherwise("Alluvial Soil"))


def ndvi_estimate(temp: Column, humidity: Column, rain: Column) -> Column:
    base = F.when(rain > 200, F.lit(0.55)).when(rain > 100, F.lit(0.40)).when(rain > 50, F.lit(0.25)).otherwise(F.lit(0.10))
    base = base + F.when(humidity > 75, F.lit(0.08)).when(humidity < 40, F.lit(-0.05)).otherwise(F.lit(0.0))
    base = base + F.when(temp > 40, F.lit(-0.10)).when(temp < 10, F.lit(-0.05)).otherwise(F.lit(0.0))
    return N.round_to(N.clip(base, -0.1, 0.9), 2)


def ndvi_status(ndvi: Column) -> Column:
    return (F.when(ndvi >= 0.60, "excellent").when(ndvi >= 0.40, "good").when(ndvi >= 0.20, "moderate").when(ndvi >= 0.10, "poor")
            .when(ndvi >= -1.0, "unsuitable").otherwise("unknown"))


def moisture_estimate(humidity: Column, rain: Column) -> Column:
    return N.round_to(F.least(F.lit(0.5), (rain / F.lit(500.0)) * (humidity / F.lit(100.0)) + F.lit(0.05)), 3)


def moisture_status(m: Column) -> Column:
    return (F.when(m >= 0.40, "wet").when(m >= 0.25, "adequate").when(m >= 0.10, "dry").when(m >= -1.0, "arid").otherwise("unknown"))


def vegetation_score(ndvi: Column, moisture: Column) -> Column:
    def part(c: Column) -> Column:
        return N.clip(F.floor(c).cast("double"), 0.0, 100.0)

    a = part(F.greatest((ndvi + F.lit(0.1)) * F.lit(80.0), F.lit(0.0)))
    return F.floor(a * F.lit(0.6) + part(moisture * F.lit(250.0)) * F.lit(0.4)).cast("bigint")


def vegetation_warnings(ndvi: Column, moisture: Column, temp: Column) -> Column:
    w = F.array(F.when(ndvi < 0.15, F.lit("VERY_LOW_VEGETATION")), F.when(ndvi > 0.60, F.lit("EXCELLENT_VEGETATION")),
                F.when(moisture < 0.12, F.lit("LOW_SOIL_MOISTURE")), F.when(temp > 42, F.lit("EXTREME_HEAT")))
    return F.filter(w, lambda x: x.isNotNull())


def ndvi_policy(ndvi: Column) -> Column:
    level = F.when(ndvi >= 0.50, "good").when(ndvi >= 0.30, "moderate").when(ndvi >= 0.15, "poor").otherwise("drought_only")
    return F.struct((ndvi >= 0.50).alias("allow_water_intensive"), F.lit(True).alias("allow_drought_crops"), level.alias("min_suitability"))


def effective_rain(rain: Column, humidity: Column) -> Column:
    return F.when(rain > 0, rain).when(humidity > 75, F.lit(200.0)).when(humidity > 60, F.lit(150.0)).otherwise(F.lit(40.0))


def agronomic_score(soil: Column, weather: Column, water: Column, rotation: Column, duration: Column) -> Column:
    return (soil * F.lit(0.25) + weather * F.lit(0.25) + water * F.lit(0.20) + rotation * F.lit(0.15) + duration * F.lit(0.15))


def candidate_confidence(history: Column, agronomic: Column, model: Column) -> Column:
    """With a model score .35/.35/.30, without one half and half."""
    with_model = history * F.lit(0.35) + agronomic * F.lit(0.35) + model * F.lit(0.30)
    return N.round_to(F.when(model.isNotNull(), with_model).otherwise(history * F.lit(0.5) + agronomic * F.lit(0.5)), 4)


# ------------------------------------------------------------- price decisions
def change_pct(current: Column, predicted: Column) -> Column:
    return (predicted - current) / current * F.lit(100.0)


def outlook_decision(crop: Column, change: Column, age_days: Column, disrupted: Column) -> Column:
    """SELL, HOLD or WAIT: stale data and small moves wait; a weak HOLD waits during a disruption."""
    threshold = F.when(_in(crop, dims.HIGH_UNCERTAINTY_CROPS), F.lit(5.0)).otherwise(F.lit(3.0))
    return (F.when(F.coalesce(age_days > 14, F.lit(False)), "WAIT").when(F.abs(change) < threshold, "WAIT")
            .when(change <= -threshold, "SELL").when(disrupted & (change < 8.0), "WAIT").otherwise("HOLD"))


def plain_decision(crop: Column, change: Column, age_days: Column) -> Column:
    return outlook_decision(crop, change, age_days, F.lit(False))


def advisory_action(current: Column, predicted: Column, available: Column) -> Column:
    """Three percent either way; no action at all without a valid price and forecast."""
    change = change_pct(F.when(current > 0, current), predicted)
    usable = F.coalesce(available & (current > 0) & (predicted > 0), F.lit(False))
    return (F.when(~usable, F.lit(None).cast("string")).when(change <= -3.0, "SELL").when(change >= 3.0, "HOLD").otherwise("WAIT"))


def storage_decision(change: Column) -> Column:
    return F.when(change > 5.0, "HOLD").otherwise("SELL")


def net_gain(change: Column, storage: float = 2.0) -> Column:
    return N.round_to(change - F.lit(float(storage)), 2)


def horizon_factor(days: Column) -> Column:
    return (F.when(days <= 7, F.lit(1.0)).when(days <= 15, F.lit(0.95)).when(days <= 30, F.lit(0.90)).when(days <= 60, F.lit(0.80)).otherwise(F.lit(0.70)))


def age_factor(age: Column) -> Column:
    return F.when(age < 1, F.lit(1.0)).when(age <= 3, F.lit(0.95)).when(age <= 7, F.lit(0.85)).otherwise(F.lit(0.70))


def forecast_confidence(mae: Column, mean_price: Column, horizon: Column, age: Column) -> dict[str, Column]:
    mean = F.when(mean_price > 0, mean_price).otherwise(F.lit(2000.0))
    base = F.greatest(F.lit(1.0) - F.least(mae / mean, F.lit(0.5)), F.lit(0.5))
    score = N.clip(base * horizon_factor(horizon) * age_factor(age), 0.40, 0.95)

    def pct(c: Column) -> Column:
        return F.floor(c * F.lit(100.0) + F.lit(0.5)).cast("bigint")

    return {"confidence_score": N.round_to(score, 4), "confidence_pct": N.round_to(score * F.lit(100.0), 1), "model_quality": pct(base),
            "horizon_penalty": pct(horizon_factor(horizon)), "data_freshness": pct(age_factor(age))}


def trend_direction(change: Column) -> Column:
    return F.when(change > 2.0, "UPWARD").when(change < -2.0, "DOWNWARD").otherwise("STABLE")


def trend_strength(change: Column, slope_pct: Column) -> Column:
    a, b = F.abs(change), F.abs(slope_pct)
    return F.when((a >= 8.0) | (b >= 0.25), "HIGH").when((a >= 3.0) | (b >= 0.08), "MEDIUM").otherwise("LOW")


def forecast_scope(records: Column) -> Column:
    return F.when(records >= 200, "STATE_CROP").when(records >= 50, "STATE_AWARE").otherwise("CROP_ONLY")
