"""Crop advice queries over request, cultivation and signal tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow import dims
from furrow.functions import numeric as N
from furrow.functions import scoring as R
from furrow.functions import text as X
from furrow.operators import advice as ad
from furrow.operators import clean, news
from furrow.operators import places as pl
from furrow.plans import places as PP
from furrow.plans import sql as S
from furrow.session import cut_lineage, spread
from furrow.sources import tables as T

# Soil pH ranges, calendars, tolerances and soils used as inputs here: fixed values.
REQUIREMENTS = [("Rice", 5.5, 7.5), ("Wheat", 6.0, 7.5), ("Maize", 5.8, 7.8), ("Potato", 5.2, 6.8), ("Onion", 6.0, 7.5)]
CALENDAR = {"Wheat": ["Rabi"], "Potato": ["Rabi"], "Rice": ["Kharif"]}
TOLERANCES = [
    ("Coconut", ["Laterite Soil", "Coastal Alluvial Soil", "Sandy Soil"], 20, 38, 100, 400, []),
    ("Ginger", ["Laterite Soil", "Red Soil", "Alluvial Soil"], 20, 32, 100, 300, ["Kharif"]),
    ("Rice", ["Alluvial Soil", "Laterite Soil", "Black Soil", "Coastal Alluvial Soil"], 22, 35, 100, 500, ["Kharif"]),
    ("Wheat", ["Alluvial Soil", "Black Soil"], 10, 25, 10, 75, ["Rabi"]),
    ("Maize", ["Alluvial Soil", "Red Soil", "Black Soil"], 21, 32, 25, 100, ["Kharif", "Rabi"]),
    ("Cotton", ["Black Soil"], 21, 30, 25, 85, ["Kharif"]),
]
DISTRICT_SOILS = [("nagpur", 1, "Black Soil"), ("east godavari", 2, "Coastal Alluvial Soil"), ("kutch", 3, "Desert Soil"), ("mysore", 4, "Red Soil")]
SIGNAL_STATES = [(f"S{i}", dims.STATE_SPELLINGS.get(n, n.title())) for i, n in enumerate(T.NATION_SPELLINGS[:20])]
CUTS, MUCH, YEARS = (10, 5, 1), 10_000, 7
# Traded volume from which a district or state counts as having a market for a crop.
TRADED_DISTRICT, TRADED_STATE = 50_000, 10_000


def _spots(spark, sf):
    """Canonical state and district of each place named in the facts."""
    named = T.table(spark, sf, "customer").select(
        T.pick(F.col("c_nationkey"), T.NATION_SPELLINGS).alias("state"),
        F.element_at(F.create_map(*[F.lit(x) for kv in T.SEGMENT_PLACES.items() for x in kv]), F.col("c_mktsegment")).alias("district")).distinct()
    spots = pl.resolve_aliases(named)
    return spots.select("state", "district", X.normalize_state(F.col("canonical_state")).alias("c_state"), F.col("canonical_name").alias("c_district"))


def facts(spark, sf):
    """Cultivation facts rolled up to place, crop, year and season, with canonical places."""
    f = ad.rollup_facts(T.cultivation(spark, sf)).join(_spots(spark, sf), ["state", "district"])
    return f.select(F.col("c_state").alias("state"), F.col("c_district").alias("district"), "crop", "crop_year", "season", "production", "facts")


def matrix(spark, sf, f=None):
    """Candidates of every place and season."""
    return ad.candidate_matrix(facts(spark, sf) if f is None else f, YEARS)


def _requests(spark, sf):
    return ad.prepare_requests(T.requests(spark, sf))


def _news(spark, sf):
    v = news.verify_signals(T.signals(spark, sf))
    names = dims.frame(spark, SIGNAL_STATES, "s string, name string")
    return v.join(names, v.state == names.s).select(F.col("name").alias("state"), "crop", "news_adjustment", "verification_status")


def scored(spark, sf):
    # Four lookups derive from the rolled-up facts, so those are written once.
    f = cut_lineage(facts(spark, sf), "facts")
    req = spark.createDataFrame([(c, (lo, hi)) for c, lo, hi in REQUIREMENTS], "crop string, soil_ph struct<min: double, max: double>")
    md = f.groupBy("district", "crop").agg(F.sum("production").alias("t")).where(F.col("t") >= TRADED_DISTRICT)
    ms = f.groupBy("state", "crop").agg(F.sum("production").alias("t")).where(F.col("t") >= TRADED_STATE)
    pairs = ad.expand_candidates(_requests(spark, sf), matrix(spark, sf, f))
    return ad.score(pairs, ad.evidence(f), req, CALENDAR, _news(spark, sf), md, ms, CUTS, MUCH)


def request_validation(spark, sf):
    return clean.validate_requests(T.requests(spark, sf)).select("request_id", "invalid_reason")


def outlook_request_validation(spark, sf):
    r = T.requests(spark, sf).select("request_id", F.col("previous_crop").alias("crop"), T.pick(F.col("request_id") % 6, [7, 15, 30, 60, 90, 45]).alias("horizon_days"))
    return clean.validate_outlook_requests(r).select("request_id", "invalid_reason")


def cultivation_evidence(spark, sf):
    e = ad.evidence(facts(spark, sf))
    return e.select("state", "district", "crop", F.array_join(F.col("years_present").cast("array<string>"), ",").alias("years_present"),
                    "total_production", F.array_join("seasons_present", ",").alias("seasons_present"))


def top_crops(spark, sf):
    t = ad.top_crops(facts(spark, sf), n=4)
    return t.withColumn("position", F.col("position").cast("bigint"))


def top_crops_by_state(spark, sf):
    t = ad.top_crops(facts(spark, sf), by=("state",), n=3)
    return t.withColumn("position", F.col("position").cast("bigint"))


def candidate_fallback(spark, sf):
    c = ad.candidates(_requests(spark, sf), matrix(spark, sf))
    names = F.array_join(F.transform("crops", lambda e: e["crop"]), ",")
    return c.select("canonical_id", "state", "district", "season", "canonical_season", "level", names.alias("crops"))


def advice_scores(spark, sf):
    s = scored(spark, sf)
    return s.select("request_id", "crop", "level", "evidence_points", "season_points", "soil_points", "soil_status", "water_points", "water_status",
                    "rotation_points", "model_points", "news_points", "news_status", "market_points", "final_score", "rejection_stage", "rejection_reason")


def advice_top5(spark, sf):
    return ad.accepted_top(scored(spark, sf)).select("request_id", F.col("rank").cast("bigint").alias("rank"), "crop", "final_score")


def advice_rejected(spark, sf):
    return ad.rejected_first(scored(spark, sf)).select("request_id", F.col("rank").cast("bigint").alias("rank"), "crop", "rejection_stage", "rejection_reason")


def market_quotes(spark, sf):
    """The newest quote of every crop for every place that customers name."""
    c = F.col
    base = T.cultivation(spark, sf).join(_spots(spark, sf), ["state", "district"]).select(
        F.concat("c_state", F.lit("::"), "c_district").alias("canonical_id"), c("c_state").alias("state"), c("c_district").alias("district"), "crop",
        F.make_date(c("crop_year").cast("int"), F.lit(1), F.lit(1)).alias("ds"), c("production").cast("double").alias("price"))
    days = base.groupBy("state", "crop", "ds").agg(F.max("price").alias("price"))
    latest = days.groupBy("state", "crop").agg(F.max(F.struct("ds", "price")).alias("m")).select("state", "crop", "m.ds", "m.price")
    crops = F.explode(F.array(*[F.lit(x) for x in T.TYPE_CROPS.values()]))
    asked = _requests(spark, sf).select("canonical_id", "state", "district").distinct().select("*", crops.alias("crop"))
    return ad.market_quote(asked, base, latest)


def news_for_requests(spark, sf):
    names = dims.frame(spark, SIGNAL_STATES, "s string, name string")
    ev = T.signals(spark, sf).select("event_id", "state", "crop")
    ev = ev.join(names, ev.state == names.s).select("event_id", F.col("name").alias("state"),
                                                    F.when(F.col("crop") == "Rice", "Rice (basmati)").otherwise(F.col("crop")).alias("crop"))
    return ad.news_for_crops(_requests(spark, sf), ev)


def suitability_top3(spark, sf):
    t = ad.top_crops(facts(spark, sf))
    lists = t.withColumn("label", pl.crop_label(F.col("crop"))).where("label IS NOT NULL").groupBy("state", "district", "label").agg(F.min("position").alias("position"))
    r = _requests(spark, sf)
    p = r.join(lists, ["state", "district"]).withColumn("position", F.col("position") - 1)
    c = F.col
    pairs = p.select(
        "request_id", "label", "position", F.when((c("request_id") + c("position")) % 5 != 0, ((c("request_id") * 7 + c("position") * 13) % 100) / F.lit(1000.0)).alias("p"),
        "n", c("p").alias("p_"), "k", F.coalesce("soil_ph", F.lit(6.5)).alias("ph"), (F.lit(15.0) + c("request_id") % 20).alias("temp"),
        (F.lit(50.0) + c("request_id") % 200).alias("rain"), c("canonical_season").alias("season"), F.concat("district", F.lit(", "), "state").alias("location"))
    s = ad.suitability(pairs)
    return s.withColumn("rank", c("rank").cast("bigint")).withColumn("position", c("position").cast("bigint"))


def labels_outside_candidates(spark, sf):
    t = facts(spark, sf).select("state", "district", "crop").distinct()
    labelled = t.select("state", "district", pl.crop_label(F.col("crop")).alias("label")).where("label IS NOT NULL").distinct()
    have = _requests(spark, sf).join(labelled, ["state", "district"]).select("request_id", "label")
    asked = T.requests(spark, sf).select("request_id", F.explode(F.array(*[F.lit(x) for x in ("rice", "wheat", "mungbean", "coffee")])).alias("label"))
    return ad.labels_outside(asked, have)


def soil_resolution(spark, sf):
    r = T.requests(spark, sf)
    r = r.withColumn("n", F.when(F.col("request_id") % 3 == 0, F.col("n")))
    soils = spark.createDataFrame(DISTRICT_SOILS, "key string, ord bigint, soil_type string")
    return ad.resolve_soil(r, soils)


def _soil_payloads(spark, sf):
    r = T.requests(spark, sf).select("request_id", "lat", "lon")
    k = F.col("request_id")

    def layer(name: str, value) -> F.Column:
        return F.concat(F.lit(f'{{"name":"{name}","depths":[{{"values":{{"mean":'), F.coalesce(value.cast("string"), F.lit("null")), F.lit("}}]}"))

    layers = F.concat_ws(",", layer("phh2o", 45 + k % 50), layer("clay", 50 + (k * 7) % 400), layer("sand", F.when(k % 11 != 0, (k * 13) % 800)), layer("soc", k % 90))
    return r.select(k.alias("point_id"), "lat", "lon", F.concat(F.lit('{"properties":{"layers":['), layers, F.lit("]}}")).alias("payload"))


def soil_layers(spark, sf):
    return ad.soil_layers(_soil_payloads(spark, sf))


def soil_classes(spark, sf):
    p = _soil_payloads(spark, sf)
    return ad.classified_soil(ad.soil_layers(p, keep=("point_id", "lat", "lon")))


def _live(spark, sf):
    """Weather payloads: every tenth point has no temperatures."""
    k = F.col("request_id")
    hours = F.sequence(F.lit(0), F.lit(167))

    def series(step: int, span: int) -> F.Column:
        return F.transform(hours, lambda i: (((k * 31 + i * step) % span) / F.lit(4.0)))

    t = F.when(k % 10 == 0, F.array().cast("array<double>")).otherwise(series(17, 160))
    doc = F.struct(F.struct(t.alias("temperature_2m"), series(13, 400).alias("relativehumidity_2m"), series(7, 12).alias("precipitation")).alias("hourly"))
    points = spread(T.requests(spark, sf).select("request_id", "state"))
    return points.select(k.alias("point_id"), F.trim("state").alias("state"), F.to_json(doc).alias("payload"))


def weather_summary(spark, sf):
    return ad.weather_summary(_live(spark, sf))


def weather_cascade(spark, sf):
    p = _live(spark, sf)
    first = ad.weather_summary(p)
    # The second provider and the normals each cover a part of the states.
    second = p.where(F.col("state") < "K").select("point_id", (F.lit(20.0) + F.col("point_id") % 9).alias("avg_temp"), F.lit(3.5).alias("total_rainfall"))
    normals = p.groupBy("state").agg(F.count(F.lit(1)).alias("n")).where(F.col("state") < "R").select("state", F.lit(26.0).alias("avg_temp"), F.col("n").cast("double").alias("total_rainfall"))
    return ad.weather_cascade(p.select("point_id", "state"), first, second, normals)


def season_climate(spark, sf):
    return ad.season_climate(T.climate_history(spark, sf))


def weather_fusion(spark, sf):
    live = ad.weather_summary(_live(spark, sf)).withColumnRenamed("point_id", "request_id")
    return ad.fuse_weather(_requests(spark, sf), ad.season_climate(T.climate_history(spark, sf)), live)


def vegetation_indices(spark, sf):
    """Latest index of an array series per request, with estimate, classes, score, warnings and policy."""
    k = F.col("request_id")
    arr = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.struct(
        F.concat(F.lit("2024-0"), i.cast("string")).alias("time"),
        F.when((k + i) % 4 != 0, ((k * 37 + i * 811) % 14000 - 2000).cast("double")).alias("value")))
    r = T.requests(spark, sf).select(k, F.when(k % 6 != 0, arr).alias("series"), (F.lit(5.0) + k % 40).alias("temp"),
                                     (F.lit(30.0) + k % 60).alias("humidity"), ((k * 3) % 260).cast("double").alias("rain"))
    v = ad.vegetation_latest(r)
    v = v.select("request_id", "temp", F.when(F.col("ndvi").isNotNull(), "satellite").otherwise("weather_estimate").alias("source"),
                 F.coalesce("ndvi", R.ndvi_estimate(F.col("temp"), F.col("humidity"), F.col("rain"))).alias("ndvi"),
                 R.moisture_estimate(F.col("humidity"), F.col("rain")).alias("moisture"))
    n, m = F.col("ndvi"), F.col("moisture")
    pol = R.ndvi_policy(n)
    return v.select("request_id", "source", "ndvi", R.ndvi_status(n).alias("ndvi_status"), "moisture", R.moisture_status(m).alias("moisture_status"),
                    R.vegetation_score(n, m).alias("suitability_score"), F.array_join(R.vegetation_warnings(n, m, F.col("temp")), ",").alias("warnings"),
                    pol["allow_water_intensive"].alias("allow_water_intensive"), pol["min_suitability"].alias("min_suitability"))


def _zone_pairs(spark, sf):
    crops = ["rice", "wheat", "cotton", "sugarcane", "coconut", "Maize"]
    r = T.requests(spark, sf).select("request_id", F.concat("district", F.lit(", "), F.trim("state")).alias("location"))
    return r.select("request_id", pl.climate_zone(F.col("location")).alias("zone"),
                    F.posexplode(F.array(*[F.lit(c) for c in crops])).alias("ord", "crop"),
                    ((F.col("request_id") % 40) / F.lit(100.0)).alias("ndvi"), ((F.col("request_id") % 23) / F.lit(50.0)).alias("moisture"))


def zone_growability(spark, sf):
    g = R.growable(F.col("crop"), F.col("zone"), F.col("ndvi"), F.col("moisture"))
    return _zone_pairs(spark, sf).select("request_id", "crop", "zone", g["growable"].alias("growable"), g["confidence"].alias("confidence"), g["why"].alias("why"))


def growable_with_minimum(spark, sf):
    g = R.growable(F.col("crop"), F.col("zone"), F.col("ndvi"), F.col("moisture"))
    p = _zone_pairs(spark, sf).select("request_id", "crop", "ord", g["growable"].alias("growable"))
    k = ad.growable_with_minimum(p)
    return k.withColumn("ord", F.col("ord").cast("bigint")).withColumn("position", F.col("position").cast("bigint"))


def _tolerance_requests(spark, sf):
    k = F.col("request_id")
    humidity = F.lit(50.0) + k % 40
    return T.requests(spark, sf).select(
        k, T.pick(k % 4, ["Black Soil", "Coastal Alluvial Soil", "Red Soil", "Desert Soil"]).alias("soil_type"), (F.lit(12.0) + k % 26).alias("temp"),
        R.effective_rain(F.when(k % 3 == 0, (k % 180).cast("double")).otherwise(F.lit(0.0)), humidity).alias("rain"), humidity.alias("humidity"),
        (k % 4 == 1).alias("is_coastal"), T.pick(k % 3, dims.FOREST_SEASONS).alias("season"))


def tolerance_scores(spark, sf):
    return ad.tolerance_scores(_tolerance_requests(spark, sf), TOLERANCES)


def _topped(spark, sf):
    t = ad.tolerance_scores(_tolerance_requests(spark, sf), TOLERANCES)
    second = t.select("request_id", F.col("crop").alias("name"), (-F.col("score")).alias("o"), "crop").select(
        "request_id", "name", F.struct("o", "crop").alias("ord"))
    first = T.requests(spark, sf).select("request_id", F.posexplode(F.array(F.lit("Tomato"), F.lit("Wheat"), F.col("previous_crop"))).alias("i", "name")).where(
        F.col("name").isNotNull()).select("request_id", "name", F.struct(F.col("i").cast("bigint").alias("o"), F.lit("").alias("crop")).alias("ord"))
    return ad.top_up(first, second, 25)


def top_up_list(spark, sf):
    return _topped(spark, sf).withColumn("position", F.col("position").cast("bigint"))


def field_crops_first(spark, sf):
    seasons = T.requests(spark, sf).select("request_id", T.pick(F.col("request_id") % 3, dims.FOREST_SEASONS).alias("season"))
    f = ad.field_crops_first(_topped(spark, sf).join(seasons, "request_id"))
    return f.withColumn("final_position", F.col("final_position").cast("bigint"))


def candidate_adapter(spark, sf):
    k = F.col("request_id")
    crops = F.posexplode(F.array(*[F.lit(c) for c in ("Rice", "Groundnut", "Cotton")])).alias("i", "crop")
    p = T.requests(spark, sf).select(k, crops, "k").select(
        "request_id", "crop", ((k % 90) / F.lit(100.0)).alias("history"), ((k % 70) / F.lit(100.0)).alias("soil"), F.lit(0.85).alias("weather"),
        F.when(k % 5 != 0, (k % 50) / F.lit(100.0)).alias("water"), ((k % 33) / F.lit(40.0)).alias("rotation"), F.lit(None).cast("double").alias("duration"),
        F.when(X.lookup(F.col("crop"), dims.CANDIDATE_LABELS).isNotNull(), (k % 101) / F.lit(100.0)).alias("model"))
    return ad.candidate_adapter(p)


def rotation_factors(spark, sf):
    f = facts(spark, sf).groupBy("crop").agg(F.sum("facts").alias("facts"))
    prev = F.explode(F.array(*[F.lit(c) for c in T.PREVIOUS_CROPS if c])).alias("previous_crop")
    p = f.select("crop", "facts", prev)
    return p.select("previous_crop", "crop", "facts", R.rotation_factor(F.col("previous_crop"), F.col("crop")).alias("factor"),
                    R.rotation_points(F.col("previous_crop"), F.col("crop")).alias("points"))


def asset_totals(spark, sf):
    return ad.asset_totals(matrix(spark, sf), T.table(spark, sf, "lineitem").select("l_orderkey"), T.table(spark, sf, "events").select("event_id"))


QUERIES = {f.__name__: f for f in [
    request_validation, outlook_request_validation, cultivation_evidence, top_crops, top_crops_by_state, candidate_fallback, advice_scores,
    advice_top5, advice_rejected, market_quotes, news_for_requests, suitability_top3, labels_outside_candidates, soil_resolution, soil_layers,
    soil_classes, weather_summary, weather_cascade, season_climate, weather_fusion, vegetation_indices, zone_growability, growable_with_minimum,
    tolerance_scores, top_up_list, field_crops_first, candidate_adapter, rotation_factors, asset_totals]}

# ------------------------------------------------------------------ check SQL
D = "CAST({} AS DOUBLE)".format
_AL = S.values("aliases", "alias, cname, cid, cstate", PP._ALIASES.values()) + ", " + S.STATE_MAP


def _canon(source: str, out: str, cols: str) -> str:
    """Rows of ``source`` with canonical state and district."""
    title = f"trim(regexp_replace({S.initcap('trim(district)')}, '(?i)\\bDistrict\\b', '', 'g'))"
    return f"""{out}_spots AS (SELECT DISTINCT state, district, lower(trim(state)) AS sc, lower(trim(district)) AS rc FROM {source}),
{out}_named AS (SELECT p.state, p.district, CASE WHEN a.cid IS NOT NULL THEN a.cstate WHEN lower(b.cstate) = sc THEN b.cstate ELSE {S.initcap('trim(p.state)')} END AS cs0,
 CASE WHEN a.cid IS NOT NULL THEN a.cname WHEN lower(b.cstate) = sc THEN b.cname ELSE {title} END AS cd
 FROM {out}_spots p LEFT JOIN aliases a ON a.alias = sc || '::' || rc LEFT JOIN aliases b ON b.alias = rc),
{out} AS (SELECT coalesce(sm.canonical, cs0) AS state, cd AS district, {cols} FROM {source} x JOIN {out}_named n ON n.state = x.state AND n.district = x.district
 LEFT JOIN state_map sm ON sm.spelling = lower(cs0))"""


FACTS = f"{S.CULTIVATION}, {_AL}, " + _canon("cultivation", "facts", "crop, crop_year, season, production")
REQ = f"{S.REQUESTS}, " + _canon("requests", "req0", "request_id, season, soil_ph, water_available_mm, previous_crop, n, p, k, lat, lon") + """,
req AS (SELECT *, state || '::' || district AS canonical_id, CASE season WHEN 'Kharif' THEN 'Kharif' WHEN 'winter season' THEN 'Rabi' WHEN 'Zaid' THEN 'Summer' ELSE 'Whole Year' END AS canonical_season FROM req0)"""
MATRIX = f"""mx0 AS (SELECT state, district, season, crop, {S.rnd('count(DISTINCT crop_year) / ' + D(7), 4)} AS evidence_score,
 CASE WHEN count(*) >= 25 THEN {S.rnd('least(count(*) / CAST(100.0 AS DOUBLE), 1)', 4)} END AS data_confidence FROM facts GROUP BY 1, 2, 3, 4),
mx AS (SELECT *, state || '::' || district AS canonical_id FROM mx0),
combos AS (SELECT DISTINCT canonical_id, state, district, season, canonical_season FROM req),
hits AS (SELECT c.canonical_id, c.state, c.district, c.season, c.canonical_season, m.crop, m.evidence_score, m.data_confidence, m.season AS ms,
 CASE WHEN m.canonical_id = c.canonical_id AND lower(m.season) = lower(c.canonical_season) THEN 1 WHEN m.canonical_id = c.canonical_id AND lower(m.season) = lower(c.season) THEN 2
  WHEN lower(m.season) = lower(c.canonical_season) THEN 3 WHEN lower(m.season) = lower(c.season) THEN 4 WHEN m.canonical_id = c.canonical_id THEN 5 ELSE 6 END AS level
 FROM combos c JOIN mx m ON m.state = c.state AND m.district = c.district),
cand AS (SELECT canonical_id, state, district, season, canonical_season, level, crop, evidence_score, data_confidence FROM (
 SELECT *, row_number() OVER (PARTITION BY canonical_id, season, crop ORDER BY ms) AS rn FROM (
  SELECT *, min(level) OVER (PARTITION BY canonical_id, season) AS best FROM hits) WHERE level = best) WHERE rn = 1)"""
_NEWSV = __import__("furrow.plans.news", fromlist=["_verify"])._verify
_fam = S.values("fam", "crop, family", dims.CROP_FAMILIES.items())
_leg = ", ".join(S.lit(c) for c in dims.LEGUME_CROPS)
_ROT = f"""CASE WHEN coalesce({{p}}, '') = '' THEN {D(0)} WHEN lower({{p}}) = lower({{c}}) THEN {D(2)} WHEN f1.family = f2.family THEN {D(5)}
 WHEN {{p}} IN ({_leg}) THEN {D(15)} ELSE {D(10)} END"""
_SOILPTS = f"CASE soil_status WHEN 'SUITABLE' THEN {D(15)} WHEN 'PARTIALLY_SUITABLE' THEN {D(7)} ELSE {D(0)} END"
_WATERPTS = f"CASE water_status WHEN 'SUITABLE' THEN {D(10)} WHEN 'LIMITED' THEN {D(6)} WHEN 'UNSUITABLE' THEN {D(2)} ELSE {D(0)} END"
SCORED = f"""{FACTS}, {REQ}, {MATRIX}, {S.SIGNALS}, {_NEWSV('state, crop')}, {S.values('sigst', 's, name', SIGNAL_STATES)}, {_fam},
{S.values('reqs', 'crop, lo, hi', REQUIREMENTS)}, {S.values('cal', 'crop, cs', [(c, s) for c, ss in CALENDAR.items() for s in ss])},
evd AS (SELECT state, district, crop, count(DISTINCT crop_year) AS yrs, CAST(sum(production) AS BIGINT) AS prod, list(DISTINCT season) AS sp FROM facts GROUP BY 1, 2, 3),
md AS (SELECT district, crop FROM facts GROUP BY 1, 2 HAVING sum(production) >= {TRADED_DISTRICT}), ms AS (SELECT state, crop FROM facts GROUP BY 1, 2 HAVING sum(production) >= {TRADED_STATE}),
st AS (SELECT r.request_id, c.crop, CAST(c.level AS BIGINT) AS level, r.soil_ph, r.season, r.canonical_season, yrs,
 list_distinct(list_concat(coalesce(sp, []), CASE WHEN c.crop IN ('Wheat', 'Potato') THEN ['Rabi'] WHEN c.crop = 'Rice' THEN ['Kharif'] ELSE ['Kharif', 'Rabi', 'Summer', 'Whole Year'] END)) AS seasons,
 coalesce(q.lo, 5.5) AS lo, coalesce(q.hi, 7.5) AS hi,
 CASE WHEN yrs IS NULL THEN {S.rnd('c.evidence_score * ' + D(6), 1)} WHEN yrs >= 10 THEN CASE WHEN prod > 10000 THEN {D(25)} ELSE {D(20)} END WHEN yrs >= 5 THEN {D(15)} WHEN yrs >= 1 THEN {D(8)} ELSE {D(4)} END AS evidence_points,
 CASE WHEN soil_ph IS NULL THEN 'UNKNOWN' WHEN soil_ph BETWEEN coalesce(q.lo, 5.5) AND coalesce(q.hi, 7.5) THEN 'SUITABLE'
  WHEN soil_ph BETWEEN {D('coalesce(q.lo, 5.5)')} - {D(0.5)} AND {D('coalesce(q.hi, 7.5)')} + {D(0.5)} THEN 'PARTIALLY_SUITABLE' ELSE 'UNSUITABLE' END AS soil_status,
 CASE WHEN water_available_mm IS NULL THEN 'UNKNOWN' WHEN water_available_mm >= 800 THEN 'SUITABLE' WHEN water_available_mm >= 400 THEN 'LIMITED' ELSE 'UNSUITABLE' END AS water_status,
 {_ROT.format(p='r.previous_crop', c='c.crop')} AS rotation_points,
 least({D(15)}, {S.rnd('coalesce(nullif(c.data_confidence, 0), nullif(c.evidence_score, 0), ' + D(0.7) + ') * ' + D(15), 2)}) AS model_points,
 coalesce(v.news_adjustment, {D(0)}) AS news_points, coalesce(v.verification_status, 'NO_INTELLIGENCE') AS news_status,
 CASE WHEN md.crop IS NOT NULL OR ms.crop IS NOT NULL THEN {D(5)} ELSE {D(0)} END AS market_points
 FROM req r JOIN cand c ON c.canonical_id = r.canonical_id AND c.season = r.season LEFT JOIN evd e ON e.state = r.state AND e.district = r.district AND e.crop = c.crop
 LEFT JOIN reqs q ON q.crop = c.crop LEFT JOIN sigst g ON g.name = r.state LEFT JOIN verified v ON v.state = g.s AND v.crop = c.crop
 LEFT JOIN md ON md.district = r.district AND md.crop = c.crop LEFT JOIN ms ON ms.state = r.state AND ms.crop = c.crop
 LEFT JOIN fam f1 ON f1.crop = r.previous_crop LEFT JOIN fam f2 ON f2.crop = c.crop),
fit AS (SELECT *, canonical_season = 'Whole Year' OR list_contains(seasons, canonical_season) OR list_contains(seasons, season) AS fits, {_SOILPTS} AS soil_points, {_WATERPTS} AS water_points FROM st),
scored AS (SELECT request_id, crop, level, evidence_points, CASE WHEN fits THEN {D(20)} ELSE {D(0)} END AS season_points, soil_points, soil_status, water_points, water_status, rotation_points,
 model_points, news_points, news_status, market_points,
 greatest({D(0)}, least({D(100)}, {S.rnd('evidence_points + ' + D(20) + ' + soil_points + water_points + rotation_points + model_points + news_points + market_points', 1)})) AS final_score,
 CASE WHEN NOT fits THEN 'SEASONAL_FILTER' WHEN soil_status = 'UNSUITABLE' THEN 'SOIL_FILTER' END AS rejection_stage,
 CASE WHEN NOT fits THEN 'Season mismatch (grows in ' || array_to_string(list_sort(seasons), ', ') || ')' WHEN soil_status = 'UNSUITABLE' THEN
  'Soil pH ' || CAST({S.rnd('soil_ph', 1)} AS VARCHAR) || ' is outside safe tolerance (' || CAST({D('lo')} AS VARCHAR) || '–' || CAST({D('hi')} AS VARCHAR) || ') for ' || crop || '.' END AS rejection_reason FROM fit)"""
_LABEL = {c: dims.CROP_LABELS.get(c.lower()) or dims.CROP_LABELS[c.split(" (")[0].lower()] for c in T.TYPE_CROPS.values()}
_ZONE = f"coalesce({PP._contained('lower(loc)', dims.ZONE_PLACES, True)}, {PP._contained('lower(loc)', dims.ZONE_STATES, True)})"


def _listed(table: dict, zone: str, crop: str, empty: str) -> str:
    arms = " ".join(f"WHEN '{z}' THEN {crop} IN ({', '.join(S.lit(c) for c in v)})" for z, v in table.items())
    return f"CASE {zone} {arms} ELSE {empty} END"


_ideal = lambda i: "CASE " + " ".join(f"WHEN label IN ({', '.join(S.lit(x) for x in ns)}) THEN {D((t, r)[i])}" for ns, t, r in dims.WEATHER_IDEALS) + f" ELSE {D(dims.WEATHER_IDEAL_DEFAULT[i])} END"
_wm = S.rnd(f"{D(0.5)} * greatest({D(1)} - abs(temp - {_ideal(0)}) / {D(25)}, {D(0.2)}) + {D(0.5)} * greatest({D(1)} - abs(rain - {_ideal(1)}) / {D(300)}, {D(0.2)})", 2)
_sm = S.rnd(f"{D(0.6)} * (CASE WHEN n + p_ + k >= 80 THEN {D(1)} ELSE {D(0.7)} END) + {D(0.4)} * (CASE WHEN ph BETWEEN 5.5 AND 7.5 THEN {D(1)} ELSE {D(0.6)} END)", 2)
_inseason = "CASE label " + " ".join(f"WHEN '{k}' THEN az IN ({', '.join(S.lit(s) for s in v)})" for k, v in dims.CROP_SEASONS.items()) + " ELSE az IN ('Kharif', 'Rabi', 'Zaid') END"
SUIT = f"""WITH {FACTS}, {REQ}, {S.values('lab', 'crop, label', _LABEL.items())},
tc AS (SELECT state, district, crop, row_number() OVER (PARTITION BY state, district ORDER BY count(*) DESC, crop) AS pos FROM facts GROUP BY 1, 2, 3),
pr AS (SELECT r.request_id, l.label, t.pos - 1 AS position, CASE WHEN (request_id + pos - 1) % 5 <> 0 THEN ((request_id * 7 + (pos - 1) * 13) % 100) / {D(1000)} ELSE {D(0.05)} END AS p,
 n, r.p AS p_, k, coalesce(soil_ph, 6.5) AS ph, {D(15)} + request_id % 20 AS temp, {D(50)} + request_id % 200 AS rain,
 CASE WHEN canonical_season = 'Summer' THEN 'Zaid' ELSE canonical_season END AS az, r.district || ', ' || r.state AS loc
 FROM req r JOIN tc t ON t.state = r.state AND t.district = r.district JOIN lab l ON l.crop = t.crop WHERE t.pos <= 10),
w AS (SELECT *, {_ZONE} AS zone, sum(p) OVER (PARTITION BY request_id) AS tot, count(*) OVER (PARTITION BY request_id) AS cnt FROM pr),
x AS (SELECT *, CASE WHEN cnt = 1 THEN {D(1)} WHEN tot > 0 THEN {S.rnd('p / tot', 4)} ELSE {S.rnd(D(1) + ' / cnt', 4)} END AS p_norm,
 NOT ({_listed(dims.ZONE_BLOCKED, 'zone', 'label', 'FALSE')}) AND ({_listed(dims.ZONE_ALLOWED, 'zone', 'label', 'TRUE')}) AS zone_ok, {_sm} AS sm, {_wm} AS wm,
 CASE WHEN position < 3 THEN {D(1)} WHEN position < 6 THEN {D(0.8)} ELSE {D(0.6)} END AS dm, CASE WHEN az = 'Whole Year' OR {_inseason} THEN {D(1)} ELSE {D(0.5)} END AS se FROM w),
y AS (SELECT request_id, label, CAST(position AS BIGINT) AS position, p, p_norm, zone_ok, {S.rnd('p_norm * ' + D(40), 1)} AS forest_points, {S.rnd('sm * ' + D(20), 1)} AS soil_points,
 {S.rnd('wm * ' + D(20), 1)} AS weather_points, {S.rnd('dm * ' + D(10), 1)} AS district_points, {S.rnd('se * ' + D(10), 1)} AS season_points FROM x),
z AS (SELECT *, {S.rnd(f"greatest({D(10)}, least({D(99)}, (forest_points + soil_points + weather_points + district_points + season_points) * (CASE WHEN zone_ok THEN {D(1)} ELSE {D(0.5)} END)))", 1)} AS suitability_score FROM y),
q AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY suitability_score DESC, position) AS rank FROM z)
SELECT * FROM q WHERE rank <= 3"""

_ZP = f"""{S.REQUESTS}, zl AS (SELECT request_id, district || ', ' || trim(state) AS loc FROM requests),
zp0 AS (SELECT request_id, {_ZONE} AS zone, (request_id % 40) / {D(100)} AS ndvi, (request_id % 23) / {D(50)} AS moisture FROM zl),
zp AS (SELECT *, lower(crop) AS lc FROM zp0, (VALUES (0, 'rice'), (1, 'wheat'), (2, 'cotton'), (3, 'sugarcane'), (4, 'coconut'), (5, 'Maize')) c(ord, crop)),
zg AS (SELECT *, CASE WHEN {_listed(dims.ZONE_BLOCKED, 'zone', 'lc', 'FALSE')} THEN 'BLOCKED_IN_ZONE' WHEN NOT ({_listed(dims.ZONE_ALLOWED, 'zone', 'lc', 'TRUE')}) THEN 'NOT_TYPICAL'
 WHEN (ndvi < 0.15 OR moisture < 0.10) AND lc IN ({', '.join(S.lit(c) for c in dims.WATER_INTENSIVE_CROPS)}) THEN 'TOO_DRY' ELSE 'SUITABLE' END AS why FROM zp)"""
_TOLV = S.values("tol", "crop, min_t, max_t, min_r, max_r", [(c, float(a), float(b), float(r), float(q)) for c, _, a, b, r, q, _ in TOLERANCES])
_near = ["Laterite Soil", "Sandy Soil", "Alluvial Soil"]
_s5 = " OR ".join(f"(crop = '{c}' AND soil_type IN ({', '.join(S.lit(s) for s in ss)}))" for c, ss, *_ in TOLERANCES)
_s2 = ", ".join(S.lit(c) for c, ss, *_ in TOLERANCES if set(ss) & set(_near))
_seas = "CASE crop " + " ".join(f"WHEN '{c}' THEN CASE WHEN season IN ({', '.join(S.lit(s) for s in ss)}) THEN 5 ELSE -3 END" for c, *_, ss in TOLERANCES if ss) + " ELSE 0 END"
_TOL = f"""{S.REQUESTS}, {_TOLV}, tr AS (SELECT request_id, {S.pick('request_id % 4', ["Black Soil", "Coastal Alluvial Soil", "Red Soil", "Desert Soil"])} AS soil_type,
 {D(12)} + request_id % 26 AS temp, {D(50)} + request_id % 40 AS humidity, CASE WHEN request_id % 3 = 0 THEN {D('request_id % 180')} ELSE {D(0)} END AS r0,
 request_id % 4 = 1 AS is_coastal, {S.pick('request_id % 3', dims.FOREST_SEASONS)} AS season FROM requests),
tr2 AS (SELECT *, CASE WHEN r0 > 0 THEN r0 WHEN humidity > 75 THEN 200 WHEN humidity > 60 THEN 150 ELSE 40 END AS rain FROM tr),
tols AS (SELECT request_id, crop, CAST((CASE WHEN {_s5} THEN 5 WHEN soil_type = 'Coastal Alluvial Soil' AND crop IN ({_s2}) THEN 2 ELSE 0 END)
 + (CASE WHEN temp BETWEEN min_t AND max_t THEN 3 ELSE 0 END) + (CASE WHEN rain BETWEEN min_r AND max_r THEN 3 ELSE 0 END)
 + (CASE WHEN is_coastal AND crop IN ({', '.join(S.lit(c) for c in dims.COASTAL_CROPS)}) THEN 4 ELSE 0 END)
 + (CASE WHEN humidity > 70 AND crop IN ({', '.join(S.lit(c) for c in dims.HUMID_CROPS)}) THEN 2 ELSE 0 END) + {_seas} AS BIGINT) AS score FROM tr2, tol),
tolk AS (SELECT * FROM tols WHERE score > 0)"""
_TOP = f"""{_TOL}, f1 AS (SELECT request_id, 'Tomato' AS name, 0 AS src, 0 AS o, '' AS c FROM requests UNION ALL SELECT request_id, 'Wheat', 0, 1, '' FROM requests
 UNION ALL SELECT request_id, previous_crop, 0, 2, '' FROM requests WHERE previous_crop IS NOT NULL UNION ALL SELECT request_id, crop, 1, -score, crop FROM tolk),
u1 AS (SELECT *, row_number() OVER (PARTITION BY request_id, lower(name) ORDER BY src, o, c, name) AS rn FROM f1),
topped AS (SELECT request_id, name, CASE WHEN src = 0 THEN 'mandi_data' ELSE 'soil_weather_model' END AS source, row_number() OVER (PARTITION BY request_id ORDER BY src, o, c, lower(name)) AS position FROM u1 WHERE rn = 1),
topk AS (SELECT * FROM topped WHERE position <= 25)"""
_pos = "CASE season " + " ".join(f"WHEN '{s}' THEN coalesce(list_position([{', '.join(S.lit(x.lower()) for x in v)}], lower(name)), 0)" for s, v in dims.SEASON_PRIORITY.items()) + " END"
_HOURS = "list_transform(range(168), lambda i: ((request_id * 31 + i * {0}) % {1}) / CAST(4.0 AS DOUBLE))"
_LIVE = f"""{S.REQUESTS}, hr AS (SELECT request_id, trim(state) AS state, request_id % 10 <> 0 AS ok, list_sum({_HOURS.format(17, 160)}) AS t, list_sum({_HOURS.format(13, 400)}) AS h, list_sum({_HOURS.format(7, 12)}) AS r FROM requests),
wx AS (SELECT request_id AS point_id, state, CASE WHEN ok THEN {S.rnd('t / 168', 2)} END AS avg_temp, CASE WHEN ok THEN {S.rnd('h / 168', 2)} END AS avg_humidity, CASE WHEN ok THEN {S.rnd('r', 2)} END AS total_rainfall,
 CASE WHEN ok THEN {S.rnd(S.rnd('r', 2) + ' / ' + D(7), 2)} END AS avg_daily_rainfall, CASE WHEN ok THEN 'OBSERVED_LIVE' ELSE 'UNAVAILABLE' END AS weather_status FROM hr)"""
_SEASON_ROWS = [(s, m) for s, ms in dims.SEASON_MONTHS.items() for m in ms]
_SC = f"""{S.CLIMATE}, {S.values('sea', 'season, m', _SEASON_ROWS)}, sclim AS (SELECT season, CAST(CAST(sum({S.whole('avg_temp * 1000000.0')}) AS BIGINT) AS DOUBLE) / count(*) / 1000000.0 AS hist_temp,
 CAST(CAST(sum({S.whole('total_rainfall * 1000000.0')}) AS BIGINT) AS DOUBLE) / count(*) / 1000000.0 AS hist_rain FROM climate JOIN sea ON m = month GROUP BY 1)"""
_SL = f"""{S.REQUESTS}, sl AS (SELECT request_id AS point_id, lat, lon, {S.rnd('(45 + request_id % 50) / ' + D(10), 1)} AS ph, {S.rnd('(50 + (request_id * 7) % 400) / ' + D(10), 1)} AS clay_pct,
 CASE WHEN request_id % 11 <> 0 THEN {S.rnd('((request_id * 13) % 800) / ' + D(10), 1)} END AS sand_pct, {S.rnd('(request_id % 90) / ' + D(10), 2)} AS soc FROM requests)"""
_soil = lambda i: "CASE soil_type " + " ".join(f"WHEN '{k}' THEN {D(v[i])}" for k, v in dims.SOIL_VALUES.items()) + f" ELSE {D(dims.SOIL_FALLBACK[i])} END"
_VEG = f"""{S.REQUESTS}, vg AS (SELECT request_id, {D(5)} + request_id % 40 AS temp, {D(30)} + request_id % 60 AS humidity, {D('(request_id * 3) % 260')} AS rain,
 CASE WHEN request_id % 6 <> 0 THEN list_last(list_filter(list_transform(range(10), lambda i: CASE WHEN (request_id + i) % 4 <> 0 THEN {D('(request_id * 37 + i * 811) % 14000 - 2000')} END), lambda v: v IS NOT NULL AND v / 10000.0 BETWEEN -1 AND 1)) END AS v FROM requests),
ve AS (SELECT request_id, temp, CASE WHEN v IS NOT NULL THEN 'satellite' ELSE 'weather_estimate' END AS source,
 coalesce({S.rnd('v / ' + D(10000), 3)}, {S.rnd(f"greatest({D(-0.1)}, least({D(0.9)}, (CASE WHEN rain > 200 THEN {D(0.55)} WHEN rain > 100 THEN {D(0.40)} WHEN rain > 50 THEN {D(0.25)} ELSE {D(0.10)} END) + (CASE WHEN humidity > 75 THEN {D(0.08)} WHEN humidity < 40 THEN {D(-0.05)} ELSE {D(0)} END) + (CASE WHEN temp > 40 THEN {D(-0.10)} WHEN temp < 10 THEN {D(-0.05)} ELSE {D(0)} END)))", 2)}) AS ndvi,
 {S.rnd(f"least({D(0.5)}, (rain / {D(500)}) * (humidity / {D(100)}) + {D(0.05)})", 3)} AS moisture FROM vg)"""

ORACLES = {
    "request_validation": f"WITH {S.REQUESTS} SELECT request_id, CASE WHEN n > 300 THEN 'N_OUT_OF_RANGE' WHEN soil_ph < 1 OR soil_ph > 14 THEN 'SOIL_PH_OUT_OF_RANGE' END AS invalid_reason FROM requests",
    "outlook_request_validation": f"""WITH {S.REQUESTS} SELECT request_id, CASE WHEN coalesce(lower(previous_crop), '') NOT IN ('rice', 'wheat', 'maize', 'onion', 'potato') THEN 'CROP_NOT_SUPPORTED'
 WHEN request_id % 6 = 5 THEN 'HORIZON_NOT_SUPPORTED' END AS invalid_reason FROM requests""",
    "cultivation_evidence": f"""WITH {FACTS} SELECT state, district, crop, string_agg(DISTINCT CAST(crop_year AS VARCHAR), ',' ORDER BY CAST(crop_year AS VARCHAR)) AS years_present,
 CAST(sum(production) AS BIGINT) AS total_production, string_agg(DISTINCT season, ',' ORDER BY season) AS seasons_present FROM facts GROUP BY 1, 2, 3""",
    "top_crops": f"WITH {FACTS} SELECT * FROM (SELECT state, district, crop, count(*) AS freq, row_number() OVER (PARTITION BY state, district ORDER BY count(*) DESC, crop) AS position FROM facts GROUP BY 1, 2, 3) WHERE position <= 4",
    "top_crops_by_state": f"WITH {FACTS} SELECT * FROM (SELECT state, crop, count(*) AS freq, row_number() OVER (PARTITION BY state ORDER BY count(*) DESC, crop) AS position FROM facts GROUP BY 1, 2) WHERE position <= 3",
    "candidate_fallback": f"""WITH {FACTS}, {REQ}, {MATRIX} SELECT c.canonical_id, c.state, c.district, c.season, c.canonical_season, CAST(min(level) AS BIGINT) AS level, string_agg(crop, ',' ORDER BY crop) AS crops
 FROM combos c LEFT JOIN cand d ON d.canonical_id = c.canonical_id AND d.season = c.season GROUP BY 1, 2, 3, 4, 5""",
    "advice_scores": f"WITH {SCORED} SELECT * FROM scored",
    "advice_top5": f"WITH {SCORED} SELECT request_id, rank, crop, final_score FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY final_score DESC, crop) AS rank FROM scored WHERE rejection_stage IS NULL) WHERE rank <= 5",
    "advice_rejected": f"WITH {SCORED} SELECT request_id, rank, crop, rejection_stage, rejection_reason FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY crop) AS rank FROM scored WHERE rejection_stage IS NOT NULL) WHERE rank <= 5",
    "market_quotes": f"""WITH {FACTS}, {REQ}, a AS (SELECT DISTINCT canonical_id, state, district, c.crop FROM req, (VALUES {', '.join('(' + S.lit(c) + ')' for c in T.TYPE_CROPS.values())}) c(crop)),
 q AS (SELECT *, make_date(crop_year, 1, 1) AS ds, {D('production')} AS price FROM facts),
 h AS (SELECT a.*, q.ds, q.price, CASE WHEN q.state = a.state AND q.district = a.district THEN 1 WHEN q.district = a.district THEN 3 ELSE 4 END AS level
  FROM a JOIN q ON q.crop = a.crop AND (q.district = a.district OR q.state = a.state)),
 b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY canonical_id, crop ORDER BY level, ds DESC, price DESC) AS rn FROM h) WHERE rn = 1)
 SELECT a.canonical_id, a.state, a.district, a.crop, CAST(coalesce(level, 0) AS BIGINT) AS level, price, ds FROM a LEFT JOIN b ON b.canonical_id = a.canonical_id AND b.crop = a.crop""",
    "news_for_requests": f"""WITH {REQ.replace(S.REQUESTS, S.REQUESTS + ', ' + _AL)}, {S.SIGNALS}, {S.values('sigst', 's, name', SIGNAL_STATES)},
 e AS (SELECT event_id, name AS state, CASE WHEN crop = 'Rice' THEN 'rice (basmati)' ELSE lower(crop) END AS crop FROM signals JOIN sigst ON s = state),
 per AS (SELECT state, crop, count(*) AS n, max(event_id) AS latest FROM e GROUP BY 1, 2),
 k AS (SELECT DISTINCT crop FROM e), m AS (SELECT name, crop FROM (SELECT lower(previous_crop) AS name, k.crop, row_number() OVER (PARTITION BY lower(previous_crop) ORDER BY CASE WHEN lower(previous_crop) = k.crop THEN 0 ELSE 1 END, k.crop) AS rn
  FROM (SELECT DISTINCT previous_crop FROM req WHERE previous_crop IS NOT NULL) r JOIN k ON contains(lower(previous_crop), k.crop) OR contains(k.crop, lower(previous_crop))) WHERE rn = 1)
 SELECT request_id, r.state, previous_crop AS crop, coalesce(per.n, 0) AS events, latest AS latest_event FROM req r LEFT JOIN m ON m.name = lower(previous_crop) LEFT JOIN per ON per.state = r.state AND per.crop = m.crop""",
    "suitability_top3": SUIT,
    "labels_outside_candidates": f"""WITH {FACTS}, {REQ}, {S.values('lab', 'crop, label', _LABEL.items())},
 tc AS (SELECT DISTINCT state, district, crop FROM facts)
 SELECT r.request_id, a.label FROM req r, (VALUES ('rice'), ('wheat'), ('mungbean'), ('coffee')) a(label) WHERE NOT EXISTS
 (SELECT 1 FROM tc JOIN lab ON lab.crop = tc.crop WHERE tc.state = r.state AND tc.district = r.district AND lab.label = a.label)""",
    "soil_resolution": f"""WITH {S.REQUESTS}, r AS (SELECT request_id, CASE WHEN request_id % 3 = 0 THEN n END AS n, p, k, soil_ph, {S.case_map('district', {'Nagpur': 'Black Soil', 'East Godavari': 'Coastal Alluvial Soil', 'Kutch': 'Desert Soil', 'Mysore District': 'Red Soil'})} AS soil_type FROM requests),
 u AS (SELECT *, n IS NOT NULL AND soil_ph IS NOT NULL AS usr FROM r)
 SELECT request_id, CASE WHEN usr THEN n ELSE {_soil(0)} END AS n, CASE WHEN usr THEN p ELSE {_soil(1)} END AS p, CASE WHEN usr THEN k ELSE {_soil(2)} END AS k, CASE WHEN usr THEN soil_ph ELSE {_soil(3)} END AS ph,
 CASE WHEN usr THEN 'User Provided' ELSE coalesce(soil_type, 'Unknown') END AS soil_type, CASE WHEN usr THEN 'user_provided' WHEN soil_type IS NOT NULL THEN 'geo_mapping' ELSE 'fallback' END AS source FROM u""",
    "soil_layers": f"WITH {_SL} SELECT point_id, ph, clay_pct, sand_pct, soc FROM sl",
    "soil_classes": f"""WITH {_SL} SELECT *, CASE WHEN sand_pct IS NOT NULL THEN CASE WHEN lat >= 28.5 AND clay_pct < 25 AND sand_pct < 50 THEN 'Mountain Soil'
  WHEN sand_pct > 68 THEN CASE WHEN lat > 24 AND lon < 76 THEN 'Desert Soil' ELSE 'Sandy Soil' END WHEN clay_pct > 38 AND ph BETWEEN 7.2 AND 8.8 THEN 'Black Soil'
  WHEN ph < 5.5 AND clay_pct > 20 THEN 'Laterite Soil' WHEN ph >= 7 AND clay_pct < 30 AND lon > 78 AND lat < 18 THEN 'Coastal Alluvial Soil'
  WHEN ph BETWEEN 5.5 AND 7.2 AND clay_pct BETWEEN 15 AND 35 AND soc < 5 THEN 'Red Soil' ELSE 'Alluvial Soil' END
 ELSE CASE WHEN lat >= 24 AND lon BETWEEN 88 AND 97 THEN 'Alluvial Soil' WHEN lat >= 28 AND (lon < 80 OR lon > 88) THEN 'Mountain Soil' WHEN lat BETWEEN 22 AND 30 AND lon BETWEEN 68 AND 77 THEN 'Desert Soil'
  WHEN lat BETWEEN 13 AND 22 AND lon BETWEEN 73 AND 80 THEN 'Black Soil' WHEN lon < 77 AND lat < 20 THEN 'Laterite Soil' WHEN lon > 79 AND lat < 18 THEN 'Coastal Alluvial Soil' ELSE 'Alluvial Soil' END END AS soil_type,
 CASE WHEN sand_pct IS NOT NULL THEN 'high' ELSE 'low' END AS confidence FROM sl""",
    "weather_summary": f"WITH {_LIVE} SELECT point_id, avg_temp, avg_humidity, total_rainfall, avg_daily_rainfall, {S.rnd('avg_daily_rainfall * ' + D(30), 2)} AS monthly_rainfall, weather_status FROM wx",
    "weather_cascade": f"""WITH {_LIVE}, nm AS (SELECT state, {D('count(*)')} AS n FROM wx WHERE state < 'R' GROUP BY 1)
 SELECT point_id, wx.state, CASE WHEN avg_temp IS NOT NULL THEN avg_temp WHEN wx.state < 'K' THEN {D(20)} + point_id % 9 WHEN n IS NOT NULL THEN {D(26)} END AS avg_temp,
 CASE WHEN avg_temp IS NOT NULL THEN total_rainfall WHEN wx.state < 'K' THEN {D(3.5)} ELSE n END AS total_rainfall,
 CASE WHEN avg_temp IS NOT NULL THEN 'live-1' WHEN wx.state < 'K' THEN 'live-2' WHEN n IS NOT NULL THEN 'historical-climate' ELSE 'unavailable' END AS provider,
 CASE WHEN avg_temp IS NOT NULL OR wx.state < 'K' THEN 'OBSERVED_LIVE' WHEN n IS NOT NULL THEN 'HISTORICAL_CLIMATE' ELSE 'UNAVAILABLE' END AS weather_status FROM wx LEFT JOIN nm ON nm.state = wx.state""",
    "season_climate": f"WITH {_SC} SELECT season, hist_temp, hist_rain FROM sclim",
    "weather_fusion": f"""WITH {_LIVE}, {_SC}, f AS (SELECT r.request_id, {S.case_map('r.season', {'Kharif': 'Kharif', 'winter season': 'Rabi', 'Zaid': 'Summer', 'whole year': 'Whole Year'})} AS canonical_season, avg_temp, total_rainfall,
 CASE WHEN weather_status = 'OBSERVED_LIVE' THEN {D(0.6)} ELSE {D(0.9)} END AS w FROM requests r JOIN wx ON point_id = r.request_id)
 SELECT request_id, canonical_season, {S.rnd(f'CASE WHEN avg_temp IS NULL THEN hist_temp ELSE w * hist_temp + ({D(1)} - w) * avg_temp END', 1)} AS temperature,
 {S.rnd(f'CASE WHEN total_rainfall IS NULL THEN hist_rain ELSE w * hist_rain + ({D(1)} - w) * total_rainfall END', 1)} AS rainfall, w AS history_weight FROM f JOIN sclim ON season = canonical_season""",
    "vegetation_indices": f"""WITH {_VEG} SELECT request_id, source, ndvi, CASE WHEN ndvi >= 0.6 THEN 'excellent' WHEN ndvi >= 0.4 THEN 'good' WHEN ndvi >= 0.2 THEN 'moderate' WHEN ndvi >= 0.1 THEN 'poor' ELSE 'unsuitable' END AS ndvi_status, moisture,
 CASE WHEN moisture >= 0.4 THEN 'wet' WHEN moisture >= 0.25 THEN 'adequate' WHEN moisture >= 0.1 THEN 'dry' ELSE 'arid' END AS moisture_status,
 CAST(floor(least({D(100)}, floor(greatest((ndvi + {D(0.1)}) * {D(80)}, 0))) * {D(0.6)} + least({D(100)}, floor(moisture * {D(250)})) * {D(0.4)}) AS BIGINT) AS suitability_score,
 concat_ws(',', CASE WHEN ndvi < 0.15 THEN 'VERY_LOW_VEGETATION' END, CASE WHEN ndvi > 0.6 THEN 'EXCELLENT_VEGETATION' END, CASE WHEN moisture < 0.12 THEN 'LOW_SOIL_MOISTURE' END, CASE WHEN temp > 42 THEN 'EXTREME_HEAT' END) AS warnings,
 ndvi >= 0.5 AS allow_water_intensive, CASE WHEN ndvi >= 0.5 THEN 'good' WHEN ndvi >= 0.3 THEN 'moderate' WHEN ndvi >= 0.15 THEN 'poor' ELSE 'drought_only' END AS min_suitability FROM ve""",
    "zone_growability": f"""WITH {_ZP} SELECT request_id, crop, zone, why = 'SUITABLE' AS growable, CASE why WHEN 'NOT_TYPICAL' THEN 'medium' WHEN 'TOO_DRY' THEN 'high' ELSE CASE WHEN zone IS NOT NULL THEN 'high' ELSE 'low' END END AS confidence, why FROM zg""",
    "growable_with_minimum": f"""WITH {_ZP}, r AS (SELECT request_id, crop, CAST(ord AS BIGINT) AS ord, why = 'SUITABLE' AS g, row_number() OVER (PARTITION BY request_id ORDER BY CASE WHEN why = 'SUITABLE' THEN 0 ELSE 1 END, ord) AS position,
 count(*) FILTER (why = 'SUITABLE') OVER (PARTITION BY request_id) AS n_ok FROM zg) SELECT request_id, crop, ord, CASE WHEN g THEN TRUE END AS growable, position FROM r WHERE position <= greatest(n_ok, 3)""",
    "tolerance_scores": f"WITH {_TOL} SELECT * FROM tolk",
    "top_up_list": f"WITH {_TOP} SELECT * FROM topk",
    "field_crops_first": f"""WITH {_TOP}, s AS (SELECT t.*, {S.pick('request_id % 3', dims.FOREST_SEASONS)} AS season FROM topk t), o AS (SELECT *, {_pos} AS pr, lower(name) IN ({', '.join(S.lit(c) for c in dims.MARKET_VEGETABLES)}) AS veg FROM s),
 b AS (SELECT *, CASE WHEN veg THEN 2 WHEN pr > 0 THEN 0 ELSE 1 END AS bucket, CASE WHEN pr > 0 THEN pr - 1 WHEN veg THEN 999 ELSE 0 END AS wi FROM o)
 SELECT request_id, name, CAST(bucket AS BIGINT) AS bucket, row_number() OVER (PARTITION BY request_id ORDER BY bucket, wi, position) AS final_position, lower(name) IN ({', '.join(S.lit(c) for c in dims.FIELD_CROPS)}) AS field_crop FROM b""",
    "candidate_adapter": f"""WITH {S.REQUESTS}, p AS (SELECT request_id, crop, (request_id % 90) / {D(100)} AS h, ((request_id % 70) / {D(100)}) * {D(0.25)} + {D(0.85)} * {D(0.25)}
 + coalesce(CASE WHEN request_id % 5 <> 0 THEN (request_id % 50) / {D(100)} END, {D(0.8)}) * {D(0.20)} + ((request_id % 33) / {D(40)}) * {D(0.15)} + {D(0.8)} * {D(0.15)} AS a,
 CASE WHEN crop <> 'Groundnut' THEN (request_id % 101) / {D(100)} END AS m FROM requests, (VALUES ('Rice'), ('Groundnut'), ('Cotton')) c(crop))
 SELECT request_id, crop, {S.rnd('a', 4)} AS agronomic_score, {S.rnd(f'CASE WHEN m IS NOT NULL THEN h * {D(0.35)} + a * {D(0.35)} + m * {D(0.30)} ELSE h * {D(0.5)} + a * {D(0.5)} END', 4)} AS final_confidence,
 CASE WHEN m IS NOT NULL THEN 'RF_COMPATIBLE' ELSE 'RF_INCOMPATIBLE_EVIDENCE_PRESERVED' END AS model_status FROM p""",
    "rotation_factors": f"""WITH {S.CULTIVATION}, {_fam}, f AS (SELECT crop, count(*) AS facts FROM cultivation GROUP BY 1),
 p AS (SELECT crop, facts, v.previous_crop FROM f, (VALUES {', '.join('(' + S.lit(c) + ')' for c in T.PREVIOUS_CROPS if c)}) v(previous_crop))
 SELECT previous_crop, p.crop, facts, CASE WHEN lower(previous_crop) = lower(p.crop) THEN {D(0.35)} WHEN f1.family = f2.family THEN {D(0.60)} WHEN f1.family = 'Poaceae' AND f2.family = 'Fabaceae' THEN {D(1.25)} ELSE {D(1)} END AS factor,
 {_ROT.format(p='previous_crop', c='p.crop')} AS points FROM p LEFT JOIN fam f1 ON f1.crop = previous_crop LEFT JOIN fam f2 ON f2.crop = p.crop""",
    "asset_totals": f"""WITH {FACTS}, {REQ}, {MATRIX} SELECT count(DISTINCT state || '::' || district) AS districts_with_candidates, count(*) AS candidate_rows, count(DISTINCT state) AS states_with_candidates,
 (SELECT count(*) FROM lineitem) AS market_quotes, (SELECT count(*) FROM events) AS news_signals FROM mx""",
}
