"""Crop advice for tables of requests.

Requests are resolved through distinct (state, district, season) combinations,
candidates ride along as short arrays (a district grows a bounded list of
crops), and every rejected crop keeps its stage and reason.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from furrow import dims
from furrow.functions import numeric as N
from furrow.functions import scoring as R
from furrow.functions import text as X
from furrow.operators import places
from furrow.operators.clean import settle

PLACE = ["state", "district"]
ALL_SEASONS = ["Kharif", "Rabi", "Summer", "Whole Year"]


def rollup_facts(facts: DataFrame) -> DataFrame:
    """Facts per place, crop, year and season: everything later needs only this bounded table."""
    return facts.groupBy(*PLACE, "crop", "crop_year", "season").agg(
        F.sum("production").alias("production"), F.count(F.lit(1)).alias("facts"))


def _fact_count(facts: DataFrame) -> Column:
    return F.sum("facts") if "facts" in facts.columns else F.count(F.lit(1))


def evidence(facts: DataFrame) -> DataFrame:
    """Years, total production and seasons of each (district, crop).

    Sets of years and seasons are bounded and combine on the map side.
    """
    return facts.groupBy(*PLACE, "crop").agg(
        F.array_sort(F.collect_set("crop_year")).alias("years_present"), F.sum("production").alias("total_production"),
        F.array_sort(F.collect_set("season")).alias("seasons_present"))


def top_crops(facts: DataFrame, by: Sequence[str] = tuple(PLACE), n: int = 10) -> DataFrame:
    """Most frequent crops per place with their position from one."""
    counts = facts.groupBy(*by, "crop").agg(_fact_count(facts).alias("freq"))
    pos = F.row_number().over(W.partitionBy(*by).orderBy(F.col("freq").desc(), "crop"))
    return counts.withColumn("position", pos).where(F.col("position") <= n)


def candidate_matrix(facts: DataFrame, span_years: int, least_facts: int = 25) -> DataFrame:
    """Candidates per (state, district, season): share of years grown is the evidence score.

    The confidence grows with the number of facts and is unknown below ``least_facts``.
    """
    per = facts.groupBy(*PLACE, "season", "crop").agg(F.size(F.collect_set("crop_year")).alias("y"), _fact_count(facts).alias("n"))
    return per.select(
        F.concat("state", F.lit("::"), "district").alias("canonical_id"), *PLACE, "season", "crop",
        N.round_to(F.col("y") / F.lit(float(span_years)), 4).alias("evidence_score"),
        F.when(F.col("n") >= least_facts, N.round_to(F.least(F.col("n") / F.lit(100.0), F.lit(1.0)), 4)).alias("data_confidence"))


def _key(kind: int, *parts: Column) -> Column:
    """A key of the long look-up table: its kind and up to three parts in lower case."""
    texts = [F.lower(p) for p in parts] + [F.lit("")] * (3 - len(parts))
    return F.struct(F.lit(kind).alias("kind"), *[t.alias(f"k{i}") for i, t in enumerate(texts)])


KEY = ["kind", "k0", "k1", "k2"]


def by_level(asked: DataFrame, probes: Sequence[Column], table: DataFrame, on: Sequence[str] = ()) -> DataFrame:
    """``asked`` with ``level`` and ``found``, the value of the first probe that the long key table has; null if none has.

    ``table``: the columns of ``KEY`` and ``on``, and ``value``; one row a key.  ``asked`` is written once per probe and
    meets the table in one equality join, however many levels there are.
    """
    columns = asked.columns
    wide = asked.select(*columns, F.posexplode(F.array(*probes)).alias("n", "probe")).select(*columns, (F.col("n") + 1).alias("n"), "probe.*")
    hits = wide.join(table, [*KEY, *on], "left")
    best = hits.groupBy(*columns).agg(F.min_by(F.struct(F.col("n").alias("level"), F.col("value").alias("found")), F.when(F.col("value").isNotNull(), F.col("n"))).alias("b"))
    return best.select(*columns, F.col("b.level").cast("bigint").alias("level"), F.col("b.found").alias("found"))


def candidates(requests: DataFrame, matrix: DataFrame) -> DataFrame:
    """Candidate crops of each distinct place and season, by the first level that has any.

    Levels: id and season (canonical, then as asked), state and district with
    season (both), id in any season, state and district in any season.  A key's crops are
    distinct; of several seasons the first one's scores count.
    """
    c = F.col
    keys = F.array(_key(1, c("canonical_id"), c("season")), _key(2, c("state"), c("district"), c("season")), _key(3, c("canonical_id")), _key(4, c("state"), c("district")))
    long = matrix.select(F.explode(keys).alias("k"), "crop", "evidence_score", "data_confidence", "season").select("k.*", "crop", "evidence_score", "data_confidence", "season")
    one = long.groupBy(*KEY, "crop").agg(F.min_by(F.struct("evidence_score", "data_confidence"), c("season")).alias("v"))
    entry = F.struct("crop", c("v.evidence_score").alias("evidence_score"), c("v.data_confidence").alias("data_confidence"))
    table = one.groupBy(*KEY).agg(F.array_sort(F.collect_list(entry)).alias("value"))
    asked = requests.select("canonical_id", *PLACE, "season", "canonical_season").distinct()
    i, s, d, cs, rs = (c(x) for x in ("canonical_id", "state", "district", "canonical_season", "season"))
    probes = [_key(1, i, cs), _key(1, i, rs), _key(2, s, d, cs), _key(2, s, d, rs), _key(3, i), _key(4, s, d)]
    return by_level(asked, probes, table).withColumnRenamed("found", "crops")


def prepare_requests(requests: DataFrame) -> DataFrame:
    """Canonical place, id and season of each request, resolved on distinct places."""
    spots = places.resolve_aliases(requests.select(*PLACE).distinct())
    spots = spots.select(F.col("state").alias("s"), F.col("district").alias("d"), "canonical_id",
                         X.normalize_state(F.col("canonical_state")).alias("c_state"), F.col("canonical_name").alias("c_district"))
    j = requests.join(spots, (requests.state == spots.s) & (requests.district == spots.d))
    rest = [x for x in requests.columns if x not in (*PLACE, "season")]
    return j.select(*rest, F.col("c_state").alias("state"), F.col("c_district").alias("district"),
                    F.concat("c_state", F.lit("::"), "c_district").alias("canonical_id"), "season",
                    X.normalize_season(F.col("season")).alias("canonical_season"))


def expand_candidates(requests: DataFrame, matrix: DataFrame) -> DataFrame:
    """One row per request and candidate crop."""
    lists = candidates(requests, matrix)
    keys = ["canonical_id", *PLACE, "season", "canonical_season"]
    return requests.join(lists.where(F.col("crops").isNotNull()), keys).select(
        *requests.columns, "level", F.inline("crops"))


def score(pairs: DataFrame, evidence_rows: DataFrame, requirements: DataFrame, calendar: Mapping[str, Sequence[str]],
          news: DataFrame, market_district: DataFrame, market_state: DataFrame, cuts: tuple[int, int, int] = (10, 5, 1),
          much: int = 10000) -> DataFrame:
    """Points, stages and reasons of every (request, crop); ``rejection_stage`` is null for accepted crops.

    Lookups are keyed by place and crop, requirements by crop: all equi joins
    on tables as small as the list of places times crops.
    """
    c = F.col
    ev = evidence_rows.select(F.lower("state").alias("e_s"), F.lower("district").alias("e_d"), F.lower("crop").alias("e_c"),
                              F.size("years_present").alias("n_years"), "total_production", "seasons_present")
    req = requirements.select(c("crop").alias("r_c"), c("soil_ph.min").cast("double").alias("ph_min"), c("soil_ph.max").cast("double").alias("ph_max"))
    nw = news.select(F.lower("state").alias("w_s"), F.lower("crop").alias("w_c"), "news_adjustment", "verification_status")
    md = market_district.select(F.lower("district").alias("d_d"), F.lower("crop").alias("d_c"), F.lit(True).alias("in_district")).distinct()
    ms = market_state.select(F.lower("state").alias("s_s"), F.lower("crop").alias("s_c"), F.lit(True).alias("in_state")).distinct()
    low = [F.lower("state"), F.lower("district"), F.lower("crop")]
    j = (pairs.join(ev, (low[0] == c("e_s")) & (low[1] == c("e_d")) & (low[2] == c("e_c")), "left")
         .join(req, c("crop") == c("r_c"), "left")
         .join(nw, (low[0] == c("w_s")) & (low[2] == c("w_c")), "left")
         .join(md, (low[1] == c("d_d")) & (low[2] == c("d_c")), "left")
         .join(ms, (low[0] == c("s_s")) & (low[2] == c("s_c")), "left"))
    default = F.array(*[F.lit(s) for s in ALL_SEASONS])
    listed = default
    if calendar:
        entries = [x for k, v in calendar.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))]
        listed = F.coalesce(F.try_element_at(F.create_map(*entries), c("crop")), default)
    present = F.coalesce("seasons_present", F.array().cast("array<string>"))
    seasons = F.array_distinct(F.concat(present, listed))
    whole = c("canonical_season").isin("Whole Year", "Perennial") | F.lower("season").isin("whole year", "perennial")
    perennial = c("crop").isin(*dims.PERENNIAL_CROPS)
    fits = perennial | whole | F.array_contains(seasons, c("canonical_season")) | F.array_contains(seasons, c("season"))
    ph_min, ph_max = F.coalesce("ph_min", F.lit(5.5)), F.coalesce("ph_max", F.lit(7.5))
    soil = R.soil_status(c("soil_ph"), ph_min, ph_max)
    water = R.water_status(c("water_available_mm"))
    staged = j.select(
        *pairs.columns, fits.alias("season_fits"), F.array_join(F.array_sort(seasons), ", ").alias("grows_in"), ph_min.alias("ph_low"),
        ph_max.alias("ph_high"), soil.alias("soil_status"), water.alias("water_status"), perennial.alias("is_perennial"),
        R.evidence_points(c("n_years"), c("total_production"), c("evidence_score"), cuts, much).alias("evidence_points"),
        R.rotation_points(c("previous_crop"), c("crop")).alias("rotation_points"),
        R.model_points(c("data_confidence"), c("evidence_score")).alias("model_points"),
        F.coalesce("news_adjustment", F.lit(0.0)).alias("news_points"), F.coalesce("verification_status", F.lit("NO_INTELLIGENCE")).alias("news_status"),
        F.when(F.coalesce("in_district", "in_state", F.lit(False)), F.lit(5.0)).otherwise(F.lit(0.0)).alias("market_points"))
    stage = F.when(~c("season_fits"), "SEASONAL_FILTER").when(c("soil_status") == "UNSUITABLE", "SOIL_FILTER")
    reason = (F.when(~c("season_fits"), F.concat(F.lit("Season mismatch (grows in "), "grows_in", F.lit(")")))
              .when(c("soil_status") == "UNSUITABLE", F.concat(
                  F.lit("Soil pH "), N.round_to(c("soil_ph"), 1).cast("string"), F.lit(" is outside safe tolerance ("), c("ph_low").cast("string"),
                  F.lit("–"), c("ph_high").cast("string"), F.lit(") for "), "crop", F.lit("."))))
    sp, wp = R.soil_points(c("soil_status")), R.water_points(c("water_status"))
    total = (c("evidence_points") + F.lit(20.0) + sp + wp + c("rotation_points") + c("model_points") + c("news_points") + c("market_points"))
    return staged.select(
        *pairs.columns, "is_perennial", "evidence_points", F.when(c("season_fits"), F.lit(20.0)).otherwise(F.lit(0.0)).alias("season_points"),
        sp.alias("soil_points"), "soil_status", wp.alias("water_points"), "water_status", "rotation_points", "model_points", "news_points",
        "news_status", "market_points", N.clip(N.round_to(total, 1), 0.0, 100.0).alias("final_score"),
        stage.alias("rejection_stage"), reason.alias("rejection_reason"))


def accepted_top(scored: DataFrame, k: int = 5) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("request_id").orderBy(F.col("final_score").desc(), "crop"))
    return scored.where(F.col("rejection_stage").isNull()).withColumn("rank", rank).where(F.col("rank") <= k)


def rejected_first(scored: DataFrame, k: int = 5) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("request_id").orderBy("crop"))
    return scored.where(F.col("rejection_stage").isNotNull()).withColumn("rank", rank).where(F.col("rank") <= k)


def market_quote(requests: DataFrame, quotes: DataFrame, latest: DataFrame) -> DataFrame:
    """Quote of each distinct (place, crop): by id, state and district, district, state, then the keyed cache.

    ``quotes``: canonical_id, state, district, crop, price, ds (any key column
    may be null).  The newest day wins per key, of a day the dearest quote.  Raw quotes become one number per
    place, crop and day by a hash aggregation before anything else.
    """
    c = F.col
    days = quotes.groupBy("canonical_id", *PLACE, "crop", "ds").agg(F.max("price").alias("price"))
    keys = F.array(_key(1, c("canonical_id")), _key(2, c("state"), c("district")), _key(3, c("district")), _key(4, c("state")))
    long = days.select(F.explode(keys).alias("k"), "crop", "ds", "price").select("k.*", "crop", "ds", "price")
    cached = latest.select(_key(5, c("state")).alias("k"), "crop", "ds", "price").select("k.*", "crop", "ds", "price")
    whole = long.union(cached).where("k0 IS NOT NULL AND k1 IS NOT NULL")
    table = whole.groupBy(*KEY, "crop").agg(F.max(F.struct("ds", "price")).alias("value"))
    asked = requests.select("canonical_id", *PLACE, "crop").distinct()
    probes = [_key(1, c("canonical_id")), _key(2, c("state"), c("district")), _key(3, c("district")), _key(4, c("state")), _key(5, c("state"))]
    found = by_level(asked, probes, table, ["crop"])
    return found.select("canonical_id", *PLACE, "crop", F.coalesce("level", F.lit(0).cast("bigint")).alias("level"), c("found.price").alias("price"), c("found.ds").alias("ds"))


def news_for_crops(requests: DataFrame, events: DataFrame, crop: str = "previous_crop") -> DataFrame:
    """Events of the request's state and crop; crop names match equal, else contained either way.

    Names are matched as distinct names; events are counted per (state, crop)
    before they meet the requests.
    """
    asked = requests.select(F.lower(crop).alias("name")).where(F.col("name").isNotNull()).distinct()
    known = events.select(F.lower("crop").alias("key")).distinct().withColumn("ord", F.col("key"))
    hit = places.match_names(asked, known).select(F.col("name").alias("a_name"), F.col("key").alias("a_key"))
    per = events.groupBy(F.lower("state").alias("e_state"), F.lower("crop").alias("e_crop")).agg(
        F.count(F.lit(1)).alias("e_n"), F.max("event_id").alias("latest_event"))
    j = requests.join(hit, F.lower(crop) == F.col("a_name"), "left").join(
        per, (F.lower("state") == F.col("e_state")) & (F.col("a_key") == F.col("e_crop")), "left")
    return j.select("request_id", "state", F.col(crop).alias("crop"), F.coalesce("e_n", F.lit(0).cast("bigint")).alias("events"), "latest_event")


def asset_totals(matrix: DataFrame, quotes: DataFrame, signals: DataFrame) -> DataFrame:
    """One row of asset counts: places, candidates, states and districts covered, quotes, signals."""
    places_seen = matrix.groupBy(*PLACE).agg(F.count(F.lit(1)).alias("c"))
    a = places_seen.agg(F.count(F.lit(1)).alias("districts_with_candidates"), F.sum("c").alias("candidate_rows"),
                        F.size(F.collect_set("state")).cast("bigint").alias("states_with_candidates"))
    b = quotes.agg(F.count(F.lit(1)).alias("market_quotes"))
    d = signals.agg(F.count(F.lit(1)).alias("news_signals"))
    one = F.lit(1)
    # Three one-row frames side by side.
    return a.withColumn("one", one).join(b.withColumn("one", one), "one").join(d.withColumn("one", one), "one").drop("one")


# --------------------------------------------------------- probability ranking
def renormalize(pairs: DataFrame, by: str = "request_id", p: str = "p") -> DataFrame:
    """Probabilities rescaled to sum to one per request; uniform if the sum is zero, one if alone."""
    w = W.partitionBy(by)
    total, n = F.sum(p).over(w), F.count(F.lit(1)).over(w)
    norm = (F.when(n == 1, F.lit(1.0)).when(total > 0, N.round_to(F.col(p) / F.when(total > 0, total), 4))
            .otherwise(N.round_to(F.lit(1.0) / n, 4)))
    return pairs.withColumn("p_norm", norm)


def suitability(pairs: DataFrame, top: int = 3) -> DataFrame:
    """Ranked suitability of candidates with probability, soil, climate, place and season points.

    ``pairs``: request_id, label, position, p (null if the model has no such
    label), n, p_, k, ph, temp, rain, season, location.
    """
    c = F.col
    withp = renormalize(pairs.withColumn("p", F.coalesce("p", F.lit(0.05))))
    zone = places.climate_zone(c("location"))
    ok = R.growable(c("label"), zone)["growable"]
    parts = R.suitability(
        c("p_norm"), R.soil_match(c("n"), c("p_"), c("k"), c("ph")), R.weather_match(c("label"), c("temp"), c("rain")),
        R.district_match(c("position")), F.when(R.in_season(c("label"), c("season")), F.lit(1.0)).otherwise(F.lit(0.5)), c("zone_ok"))
    scored = withp.withColumn("zone_ok", ok).select(
        "request_id", "label", "position", "p", "p_norm", "zone_ok", *[v.alias(k) for k, v in parts.items()])
    rank = F.row_number().over(W.partitionBy("request_id").orderBy(c("suitability_score").desc(), "position"))
    return scored.withColumn("rank", rank).where(c("rank") <= top)


def growable_with_minimum(pairs: DataFrame, keep: int = 3) -> DataFrame:
    """Growable crops, topped up with the first blocked ones to ``keep``; those are marked uncertain.

    ``pairs``: request_id, crop, ord, growable.
    """
    w = W.partitionBy("request_id")
    pos = F.row_number().over(w.orderBy(F.col("growable").desc(), "ord"))
    n_ok = F.sum(F.col("growable").cast("int")).over(w)
    ranked = pairs.withColumn("pos", pos).withColumn("n_ok", n_ok)
    return ranked.where(F.col("pos") <= F.greatest("n_ok", F.lit(keep))).select(
        "request_id", "crop", "ord", F.when(F.col("growable"), F.lit(True)).alias("growable"), F.col("pos").alias("position"))


def top_up(first: DataFrame, second: DataFrame, size: int = 25, by: str = "request_id") -> DataFrame:
    """First list, then names of the second list that are not in it, cut to ``size`` per request.

    Both frames: by, name, ord.  A name keeps its earliest place.
    """
    both = first.select(by, "name", F.lit(0).alias("src"), "ord").unionByName(second.select(by, "name", F.lit(1).alias("src"), "ord"))
    one = both.groupBy(by, F.lower("name").alias("key")).agg(F.min(F.struct("src", "ord", "name")).alias("m"))
    pos = F.row_number().over(W.partitionBy(by).orderBy("m.src", "m.ord", "key"))
    ranked = one.withColumn("position", pos).where(F.col("position") <= size)
    return ranked.select(by, F.col("m.name").alias("name"), F.when(F.col("m.src") == 0, "mandi_data").otherwise("soil_weather_model").alias("source"),
                         "position")


def field_crops_first(items: DataFrame, by: str = "request_id") -> DataFrame:
    """Season field crops in priority order, other field crops, then market vegetables.

    ``items``: by, name, season, position.
    """
    name = F.lower("name")
    lists = F.create_map(*[x for s, v in dims.SEASON_PRIORITY.items() for x in (F.lit(s), F.array(*[F.lit(n.lower()) for n in v]))])
    prio = F.array_position(F.coalesce(F.try_element_at(lists, F.col("season")), F.array().cast("array<string>")), name)
    veg = name.isin(*dims.MARKET_VEGETABLES)
    bucket = F.when(veg, 2).when(prio > 0, 0).otherwise(1)
    within = F.when(prio > 0, prio - 1).when(veg, F.lit(999)).otherwise(F.lit(0))
    pos = F.row_number().over(W.partitionBy(by).orderBy(bucket, within, "position"))
    return items.select(by, "name", bucket.cast("bigint").alias("bucket"), pos.alias("final_position"),
                        name.isin(*dims.FIELD_CROPS).alias("field_crop"))


def tolerance_scores(requests: DataFrame, tolerances: Sequence[tuple]) -> DataFrame:
    """Soil, temperature, rain, coast, humidity and season points of every tolerance row; only positive ones stay.

    ``tolerances`` is a fixed list (crop, soils, min_t, max_t, min_r, max_r,
    seasons), so each request expands to a bounded number of rows without a join.
    ``requests``: request_id, soil_type, temp, rain, humidity, is_coastal, season.
    """
    rows = F.array(*[F.struct(
        F.lit(crop).alias("crop"), F.array(*[F.lit(s) for s in soils]).alias("soils"), F.lit(float(a)).alias("min_t"), F.lit(float(b)).alias("max_t"),
        F.lit(float(r)).alias("min_r"), F.lit(float(q)).alias("max_r"),
        (F.array(*[F.lit(s) for s in seasons]) if seasons else F.array().cast("array<string>")).alias("seasons"))
        for crop, soils, a, b, r, q, seasons in tolerances])
    c = F.col
    wide = requests.select("*", F.inline(rows))
    # Soils tried for a coastal alluvial place.  Fixed value.
    near = F.when(c("soil_type") == "Coastal Alluvial Soil", F.array(*[F.lit(s) for s in ("Laterite Soil", "Sandy Soil", "Alluvial Soil")])).otherwise(
        F.array().cast("array<string>"))
    pts = (F.when(F.array_contains("soils", c("soil_type")), 5).when(F.arrays_overlap("soils", near), 2).otherwise(0)
           + F.when(c("temp").between(c("min_t"), c("max_t")), 3).otherwise(0) + F.when(c("rain").between(c("min_r"), c("max_r")), 3).otherwise(0)
           + F.when(c("is_coastal") & c("crop").isin(*dims.COASTAL_CROPS), 4).otherwise(0)
           + F.when((c("humidity") > 70) & c("crop").isin(*dims.HUMID_CROPS), 2).otherwise(0)
           + F.when(F.size("seasons") == 0, 0).when(F.array_contains("seasons", c("season")), 5).otherwise(-3))
    return wide.select("request_id", "crop", pts.cast("bigint").alias("score")).where(F.col("score") > 0)


def candidate_adapter(pairs: DataFrame) -> DataFrame:
    """Final confidence of each candidate; the model never adds a crop of its own.

    ``pairs``: request_id, crop, history, soil, weather, water, rotation, duration, model (null if no such label).
    """
    c = F.col
    agro = R.agronomic_score(*[F.coalesce(c(n), F.lit(d)) for n, d in
                               [("soil", 0.8), ("weather", 0.8), ("water", 0.8), ("rotation", 0.75), ("duration", 0.8)]])
    history = F.coalesce("history", F.lit(0.5))
    return pairs.select(
        "request_id", "crop", N.round_to(agro, 4).alias("agronomic_score"), R.candidate_confidence(history, agro, c("model")).alias("final_confidence"),
        F.when(c("model").isNotNull(), "RF_COMPATIBLE").otherwise("RF_INCOMPATIBLE_EVIDENCE_PRESERVED").alias("model_status"))


def labels_outside(top_labels: DataFrame, candidate_rows: DataFrame) -> DataFrame:
    """Model labels of a request that are not among its candidates (audit list)."""
    return top_labels.join(candidate_rows.select("request_id", "label").distinct(), ["request_id", "label"], "left_anti")


# ------------------------------------------------------------ soil and weather
def resolve_soil(requests: DataFrame, district_soils: DataFrame) -> DataFrame:
    """Nutrients and pH: all four from the user, else the district soil type, else defaults.

    District names are matched as distinct names (equal, else contained).
    """
    names = requests.select(X.key(F.col("district")).alias("name"))
    hit = places.match_names(names, district_soils)
    tables = {i: {k: float(v[i]) for k, v in dims.SOIL_VALUES.items()} for i in range(4)}
    user = F.col("n").isNotNull() & F.col("p").isNotNull() & F.col("k").isNotNull() & F.col("soil_ph").isNotNull()
    j = requests.join(hit.select("name", "soil_type"), X.key(F.col("district")) == F.col("name"), "left")

    def value(i: int, own: str) -> Column:
        mapped = F.coalesce(X.lookup(F.col("soil_type"), tables[i]), F.lit(float(dims.SOIL_FALLBACK[i])))
        return F.when(user, F.col(own)).otherwise(mapped)

    source = F.when(user, "user_provided").when(F.col("soil_type").isNotNull(), "geo_mapping").otherwise("fallback")
    kind = F.when(user, "User Provided").otherwise(F.coalesce("soil_type", F.lit("Unknown")))
    return j.select("request_id", value(0, "n").alias("n"), value(1, "p").alias("p"), value(2, "k").alias("k"), value(3, "soil_ph").alias("ph"),
                    kind.alias("soil_type"), source.alias("source"))


def soil_layers(payloads: DataFrame, payload: str = "payload", keep: Sequence[str] = ("point_id",)) -> DataFrame:
    """Measured soil properties of each point; stored values are tenfold."""
    schema = "properties struct<layers: array<struct<name: string, depths: array<struct<values: struct<mean: double>>>>>>"
    doc = payloads.select(*keep, F.from_json(payload, schema).alias("doc"))
    rows = doc.select(*keep, F.explode("doc.properties.layers").alias("l")).select(
        *keep, F.col("l.name").alias("name"), F.get("l.depths", F.lit(0))["values"]["mean"].alias("mean"))
    wanted = {"phh2o": ("ph", 1), "clay": ("clay_pct", 1), "sand": ("sand_pct", 1), "soc": ("soc", 2)}
    wide = rows.groupBy(*keep).pivot("name", list(wanted)).agg(F.max("mean"))
    return wide.select(*keep, *[N.round_to(F.col(k) / F.lit(10.0), d).alias(n) for k, (n, d) in wanted.items()])


def classified_soil(points: DataFrame) -> DataFrame:
    """Soil type from properties where clay, sand and pH are known, else from the coordinates."""
    c = F.col
    known = c("ph").isNotNull() & c("clay_pct").isNotNull() & c("sand_pct").isNotNull()
    return points.select("*", F.when(known, R.soil_type(c("ph"), c("clay_pct"), c("sand_pct"), F.coalesce("soc", F.lit(5.0)), c("lat"), c("lon")))
                         .otherwise(R.soil_type_by_place(c("lat"), c("lon"))).alias("soil_type"),
                         F.when(known, "high").otherwise("low").alias("confidence"))


def vegetation_latest(series: DataFrame, values: str = "series") -> DataFrame:
    """Latest non-null index of an array of (time, value), scaled down; out-of-range values are skipped."""
    usable = F.filter(values, lambda e: e["value"].isNotNull() & (e["value"] / 10000.0).between(-1.0, 1.0))
    last = F.array_max(F.transform(usable, lambda e: F.struct(e["time"], e["value"])))
    return series.withColumn("ndvi", N.round_to(last["value"] / F.lit(10000.0), 3)).drop(values)


def weather_summary(payloads: DataFrame, payload: str = "payload", keep: Sequence[str] = ("point_id",)) -> DataFrame:
    """Means and totals of hourly arrays; without temperatures the row stays null, never a default."""
    schema = "hourly struct<temperature_2m: array<double>, relativehumidity_2m: array<double>, precipitation: array<double>>"
    d = settle(payloads, *[F.col(k) for k in keep], F.from_json(payload, schema).alias("doc"))

    def total(path: str) -> Column:
        return F.aggregate(F.col(f"doc.hourly.{path}"), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))

    def mean(path: str) -> Column:
        n = F.size(f"doc.hourly.{path}")
        return F.when(n > 0, N.round_to(total(path) / n, 2))

    ok = F.coalesce(F.size("doc.hourly.temperature_2m") > 0, F.lit(False))
    raw = settle(d, *[F.col(k) for k in keep], ok.alias("ok"), mean("temperature_2m").alias("t"), mean("relativehumidity_2m").alias("h"),
                 N.round_to(total("precipitation"), 2).alias("r"))
    rain = F.coalesce("r", F.lit(0.0))
    daily = N.round_to(rain / F.lit(7.0), 2)
    seen = F.col("ok")
    return raw.select(
        *keep, F.when(seen, F.col("t")).alias("avg_temp"), F.when(seen, F.coalesce("h", F.lit(0.0))).alias("avg_humidity"),
        F.when(seen, rain).alias("total_rainfall"), F.when(seen, daily).alias("avg_daily_rainfall"),
        F.when(seen, N.round_to(daily * F.lit(30.0), 2)).alias("monthly_rainfall"),
        F.when(seen, "OBSERVED_LIVE").otherwise("UNAVAILABLE").alias("weather_status"))


def weather_cascade(points: DataFrame, first: DataFrame, second: DataFrame, normals: DataFrame, key: str = "point_id",
                    region: str = "state") -> DataFrame:
    """First live provider, second live provider, climate normal of the region, else UNAVAILABLE with nulls."""
    def tagged(df: DataFrame, on: str, tag: str) -> DataFrame:
        return df.where(F.col("avg_temp").isNotNull()).select(on, F.struct("avg_temp", "total_rainfall").alias(tag))

    j = (points.join(tagged(first, key, "a"), key, "left").join(tagged(second, key, "b"), key, "left")
         .join(tagged(normals, region, "c"), region, "left"))
    best = F.coalesce("a", "b", "c")
    return j.select(
        key, region, best["avg_temp"].alias("avg_temp"), best["total_rainfall"].alias("total_rainfall"),
        F.when(F.col("a").isNotNull(), "live-1").when(F.col("b").isNotNull(), "live-2").when(F.col("c").isNotNull(), "historical-climate")
        .otherwise("unavailable").alias("provider"),
        F.when(F.coalesce("a", "b").isNotNull(), "OBSERVED_LIVE").when(F.col("c").isNotNull(), "HISTORICAL_CLIMATE").otherwise("UNAVAILABLE").alias("weather_status"))


def season_climate(history: DataFrame) -> DataFrame:
    """Mean climate of each season's months, exact in any order (millionths)."""
    pairs = F.array(*[F.struct(F.lit(s).alias("season"), F.lit(m).alias("m")) for s, ms in dims.SEASON_MONTHS.items() for m in ms])

    def micro(c: str) -> Column:
        return F.floor(F.col(c) * F.lit(1000000.0) + F.lit(0.5)).cast("bigint")

    member = history.select("month", micro("avg_temp").alias("t"), micro("total_rainfall").alias("r"), F.inline(pairs)).where(F.col("m") == F.col("month"))
    per = member.groupBy("season").agg(F.sum("t").alias("t"), F.sum("r").alias("r"), F.count(F.lit(1)).alias("n"))
    scale = F.lit(1000000.0)
    return per.select("season", (F.col("t").cast("double") / F.col("n") / scale).alias("hist_temp"),
                      (F.col("r").cast("double") / F.col("n") / scale).alias("hist_rain"))


def fuse_weather(requests: DataFrame, seasonal: DataFrame, live: DataFrame, key: str = "request_id") -> DataFrame:
    """Seasonal history blended with live weather: 0.6 history when live was observed, 0.9 when not.

    A missing live value leaves the history alone; a missing season uses 26.5 and 150.
    """
    c = F.col
    # One row per season of the fixed list.
    j = requests.select(key, "canonical_season").join(F.broadcast(seasonal), c("canonical_season") == c("season"), "left").join(
        live.select(key, c("avg_temp").alias("live_temp"), c("total_rainfall").alias("live_rain"), "weather_status"), key, "left")
    w = F.when(c("weather_status") == "OBSERVED_LIVE", F.lit(0.6)).otherwise(F.lit(0.9))
    ht, hr = F.coalesce("hist_temp", F.lit(26.5)), F.coalesce("hist_rain", F.lit(150.0))

    def blend(h: Column, live_value: str) -> Column:
        return N.round_to(F.when(c(live_value).isNull(), h).otherwise(w * h + (F.lit(1.0) - w) * c(live_value)), 1)

    return j.select(key, "canonical_season", blend(ht, "live_temp").alias("temperature"), blend(hr, "live_rain").alias("rainfall"), w.alias("history_weight"))
