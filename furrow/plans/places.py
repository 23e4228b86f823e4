"""Place and name resolution queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow import dims
from furrow.functions import text as X
from furrow.operators import places as pl
from furrow.plans import sql as S
from furrow.sources import tables as T

# Master districts, spelled variants asked for, and a guidance table: fixed values.
MASTER = [
    (1, "Karnataka::Mysuru", "Karnataka", "Mysuru"), (2, "Maharashtra::Nagpur", "Maharashtra", "Nagpur"),
    (3, "Maharashtra::Ahilya Nagar", "Maharashtra", "Ahilya Nagar"), (4, "Andhra Pradesh::East Godavari", "Andhra Pradesh", "East Godavari"),
    (5, "Andhra Pradesh::West Godavari", "Andhra Pradesh", "West Godavari"), (6, "Gujarat::Kutch", "Gujarat", "Kutch"),
    (7, "Maharashtra::Nagpur Rural", "Maharashtra", "Nagpur Rural"), (8, "West Bengal::Purba Medinipur", "West Bengal", "Purba Medinipur"),
    (9, "Goa::North Goa", "Goa", "North Goa"), (10, "Karnataka::Dakshina Kannada", "Karnataka", "Dakshina Kannada"),
]
DISTRICT_SOILS = {"nagpur": "Black Soil", "godavari": "Coastal Alluvial Soil", "kutch": "Desert Soil"}
STATE_SOILS = {"karnataka": "Red Soil", "maharashtra": "Black Soil", "assam": "Alluvial Soil", "sikkim": "Mountain Soil"}
COASTAL = ["godavari", "kutch", "puri"]
GUIDANCE = [("rice", 1, "Keep standing water until grain fill."), ("moong", 2, "Irrigate at flowering."), ("wheat", 3, "Six irrigations."),
            ("green gram", 4, "Avoid waterlogging."), ("sweet potato vine", 5, "Light, frequent watering.")]
DEFAULT_GUIDANCE = "Ensure adequate soil moisture and standard field management practices for "


def master(spark):
    return spark.createDataFrame(MASTER, "ord bigint, canonical_id string, state string, district string")


def variants(spark, sf):
    """Places as customers spell them: plain, upper case, suffixed, cut short, accented, with a note, unknown."""
    r = T.requests(spark, sf)
    k = F.col("request_id") % 8
    d = F.col("district")
    spelled = (F.when(k == 0, d).when(k == 1, F.upper(d)).when(k == 2, F.concat(d, F.lit(" Rural")))
               .when(k == 3, F.substring(d, 1, 5)).when(k == 4, F.replace(F.replace(d, F.lit("a"), F.lit("á")), F.lit("u"), F.lit("ü")))
               .when(k == 5, F.concat(d, F.lit(" (old)"))).when(k == 6, F.concat(F.lit("Zone "), (F.col("request_id") % 7).cast("string")))
               .otherwise(F.concat(F.lit("Godavari Lower "), d)))
    return r.select("request_id", "state", spelled.alias("district"))


def place_names_folded(spark, sf):
    """Every document's whole text folded like a place name."""
    return T.table(spark, sf, "documents").select("doc_id", X.fold_place(F.col("text")).alias("folded"))


def alias_resolution(spark, sf):
    v = variants(spark, sf).select("state", "district").distinct()
    return pl.resolve_aliases(v)


def district_containment(spark, sf):
    v = variants(spark, sf).select(X.key(F.col("district")).alias("name"))
    m = master(spark).select(F.lower("district").alias("key"), "ord", "canonical_id")
    return pl.match_names(v, m).select("name", F.col("match_level").cast("bigint").alias("match_level"), "key", "canonical_id")


# Spellings in two scripts: fixed values.
SPELLINGS = [(1, "Nagpur", "Maharashtra::Nagpur"), (2, "नागपुर", "Maharashtra::Nagpur"), (3, "Kutch", "Gujarat::Kutch"), (4, "कच्छ", "Gujarat::Kutch"),
             (5, "East Godavari", "Andhra Pradesh::East Godavari"), (6, "पूर्वी गोदावरी", "Andhra Pradesh::East Godavari"), (7, "Mysore District", "Karnataka::Mysuru"), (8, "मैसूर", "Karnataka::Mysuru")]
DEVANAGARI = {"Nagpur": "नागपुर", "Kutch": "कच्छ", "East Godavari": "पूर्वी गोदावरी", "Mysore District": "मैसूर"}


def district_spellings(spark, sf):
    """District names as spelled, accented or in Devanagari, with their canonical ids."""
    s = spark.createDataFrame(SPELLINGS, "ord bigint, spelling string, canonical_id string")
    r = T.requests(spark, sf)
    native = X.lookup(F.col("district"), DEVANAGARI)
    v = variants(spark, sf).select("district").union(r.select(F.coalesce(native, "district")))
    return pl.resolve_spellings(v, s)


# Top crops and soils by district and by state: fixed values.
RANKED_DISTRICTS = [(1, "Mysuru", "Karnataka", "Rice,Ragi,Sugarcane", "Red Soil"), (2, "Nagpur", "Maharashtra", "Orange,Cotton,Soybean", "Black Soil"),
                    (3, "East Godavari", "Andhra Pradesh", "Rice,Coconut", "Coastal Alluvial Soil"), (4, "Kutch", "Gujarat", "Cotton,Groundnut", "Desert Soil")]
RANKED_STATES = [(1, "Karnataka", "Ragi,Rice,Maize"), (2, "Maharashtra", "Cotton,Sugarcane"), (3, "West Bengal", "Rice,Jute"), (4, "Punjab", "Wheat,Rice"), (5, "Assam", "Tea,Rice")]


def district_ranking(spark, sf):
    """Top crops of every place that customers name, down to its state's."""
    d = spark.createDataFrame(RANKED_DISTRICTS, "ord bigint, name string, state string, top_crops string, soil_type string")
    s = spark.createDataFrame(RANKED_STATES, "ord bigint, name string, top_crops string")
    return pl.district_info(variants(spark, sf).withColumn("state", F.trim("state")), d, s)


def token_overlap(spark, sf):
    v = variants(spark, sf).select(X.fold_place(F.col("state")).alias("state_key"), X.fold_place(F.col("district")).alias("folded"))
    m = master(spark).select(X.fold_place(F.col("state")).alias("state_key"), X.fold_place(F.col("district")).alias("folded"), "ord")
    return pl.token_overlap(v, m)


def canonical_districts(spark, sf):
    c = pl.canonical_districts(variants(spark, sf), master(spark))
    return c.withColumn("rule", F.col("rule").cast("bigint"))


def location_zone(spark, sf):
    loc = F.concat("district", F.lit(", "), F.trim("state"))
    n = T.requests(spark, sf).groupBy(loc.alias("location")).agg(F.count(F.lit(1)).alias("requests"))
    return n.select("location", "requests", pl.climate_zone(F.col("location")).alias("zone"))


def location_soil(spark, sf):
    loc = F.concat("district", F.lit(", "), F.trim("state"))
    s = pl.location_soil(F.col("location"), F.col("humidity"), DISTRICT_SOILS, STATE_SOILS, COASTAL)
    n = T.requests(spark, sf).groupBy(loc.alias("location"), (F.lit(70.0) + F.col("request_id") % 12).alias("humidity")).agg(F.count(F.lit(1)).alias("requests"))
    return n.select("location", "humidity", "requests", s["soil_type"].alias("soil_type"), s["matched_by"].alias("matched_by"), s["is_coastal"].alias("is_coastal"))


def crop_guidance(spark, sf):
    names = T.cultivation(spark, sf).groupBy("crop").agg(F.count(F.lit(1)).alias("facts"))
    g = spark.createDataFrame(GUIDANCE, "key string, ord bigint, guidance string")
    hit = pl.match_names(names.select(F.lower("crop").alias("name")), g)
    return names.join(hit, F.lower("crop") == hit.name, "left").select(
        "crop", "facts", F.coalesce("guidance", F.concat(F.lit(DEFAULT_GUIDANCE), "crop", F.lit("."))).alias("guidance"))


def crop_labels(spark, sf):
    names = T.cultivation(spark, sf).select("crop").unionByName(
        T.table(spark, sf, "part").select(F.concat(F.initcap("p_type"), F.lit(" (local)")).alias("crop"))).unionByName(
        T.table(spark, sf, "part").select(F.concat(F.lit("Onion (grade "), F.col("p_size").cast("string"), F.lit(")")).alias("crop")))
    return pl.crop_labels(names)


def unresolved_names(spark, sf):
    known = dims.frame(spark, [(k,) for k in dims.CROP_LABELS], "alias string")
    return pl.unresolved_names(T.cultivation(spark, sf), known)


def _seen_master(spark, sf):
    per = T.requests(spark, sf).groupBy(F.initcap(F.trim("state")).alias("state"), "district").agg(F.min("request_id").alias("ord"))
    return per.select("ord", F.concat("state", F.lit("::"), "district").alias("canonical_id"), "state", "district")


def district_page(spark, sf):
    """First 20 districts of one state list page, in order of first appearance."""
    return pl.list_districts(_seen_master(spark, sf), None, 20)


def state_district_page(spark, sf):
    """First 100 districts of one state, whatever the case of its name."""
    return pl.list_districts(_seen_master(spark, sf), "MAHARASHTRA", 100)


def sampled_districts(spark, sf):
    return pl.sampled_districts(_seen_master(spark, sf), 20, 42)


QUERIES = {f.__name__: f for f in [
    place_names_folded, alias_resolution, district_containment, district_spellings, district_ranking, token_overlap, canonical_districts, location_zone,
    location_soil, crop_guidance, crop_labels, unresolved_names, district_page, state_district_page, sampled_districts]}

# ------------------------------------------------------------------ check SQL


def clean_sql(e: str) -> str:
    return f"trim(regexp_replace(translate(lower(coalesce({e}, '')), '{dims.ACCENTED}', '{dims.UNACCENTED}'), '[^\\x00-\\x7F]', '', 'g'))"


def fold_sql(e: str) -> str:
    out = clean_sql(e)
    for word, to in dims.PLACE_REWRITES:
        out = f"regexp_replace({out}, '\\b{word}\\b', '{to}', 'g')"
    return f"trim(regexp_replace({out}, '[^a-z0-9]+', ' ', 'g'))"


def title_sql(e: str) -> str:
    return f"regexp_replace(regexp_replace({S.initcap(e)}, '\\(o', '(O', 'g'), '', '')"


VARIANTS = S.REQUESTS + """, variants AS (SELECT request_id, state, CASE request_id % 8 WHEN 0 THEN district WHEN 1 THEN upper(district)
 WHEN 2 THEN district || ' Rural' WHEN 3 THEN substr(district, 1, 5) WHEN 4 THEN replace(replace(district, 'a', 'á'), 'u', 'ü')
 WHEN 5 THEN district || ' (old)' WHEN 6 THEN 'Zone ' || (request_id % 7) ELSE 'Godavari Lower ' || district END AS district FROM requests)"""
MASTER_SQL = S.values("master", "ord, canonical_id, state, district", MASTER)
_ALIASES = {}
for _n, _s, _sp in dims.DISTRICT_ALIASES:
    for _k in [_n.lower(), f"{_s}::{_n}".lower(), *_sp, *[f"{_s.lower()}::{x}" for x in _sp]]:
        _ALIASES[_k] = (_k, _n, f"{_s}::{_n}", _s)
RESOLVED = VARIANTS + f""", {S.values('aliases', 'alias, cname, cid, cstate', _ALIASES.values())},
pairs AS (SELECT DISTINCT state, district, {clean_sql('state')} AS sc, {clean_sql('district')} AS rc FROM variants),
resolved AS (SELECT p.state, p.district,
 CASE WHEN a.cid IS NOT NULL THEN a.cname WHEN lower(b.cstate) = sc THEN b.cname ELSE trim(regexp_replace({title_sql('trim(district)')}, '(?i)\\bDistrict\\b', '', 'g')) END AS canonical_name,
 CASE WHEN a.cid IS NOT NULL THEN a.cid WHEN lower(b.cstate) = sc THEN b.cid ELSE {S.initcap('trim(p.state)')} || '::' || trim(regexp_replace({title_sql('trim(district)')}, '(?i)\\bDistrict\\b', '', 'g')) END AS canonical_id,
 CASE WHEN a.cid IS NOT NULL THEN a.cstate WHEN lower(b.cstate) = sc THEN b.cstate ELSE {S.initcap('trim(p.state)')} END AS canonical_state,
 a.cid IS NOT NULL OR coalesce(lower(b.cstate) = sc, FALSE) AS alias_hit
 FROM pairs p LEFT JOIN aliases a ON a.alias = sc || '::' || rc LEFT JOIN aliases b ON b.alias = rc)"""
_WORDS = "list_distinct(list_filter(string_split({0}, ' '), lambda t: t <> ''))"
OVERLAP = f"""n AS (SELECT DISTINCT {fold_sql('state')} AS state_key, {fold_sql('district')} AS folded FROM variants),
mm AS (SELECT {fold_sql('state')} AS state_key, {fold_sql('district')} AS matched, ord FROM master),
sc AS (SELECT n.state_key, folded, ord, matched, CAST(len(list_intersect({_WORDS.format('folded')}, {_WORDS.format('matched')})) AS DOUBLE)
 / len(list_distinct(list_concat({_WORDS.format('folded')}, {_WORDS.format('matched')}))) AS score FROM n JOIN mm ON mm.state_key = n.state_key),
overlap AS (SELECT state_key, folded, ord, matched, score FROM (SELECT *, row_number() OVER (PARTITION BY state_key, folded ORDER BY score DESC, ord) AS rn
 FROM sc WHERE score >= 0.4) WHERE rn = 1)"""
_LOC = "district || ', ' || trim(state)"


def _contained(expr: str, table: dict, longest: bool = False) -> str:
    rows = sorted(table.items(), key=lambda kv: -len(kv[0])) if longest else table.items()
    return "CASE " + " ".join(f"WHEN contains({expr}, '{k}') THEN '{v}'" for k, v in rows) + " END"


ORACLES = {
    "place_names_folded": f"SELECT doc_id, {fold_sql('text')} AS folded FROM documents",
    "alias_resolution": f"WITH {RESOLVED} SELECT state, district, canonical_name, canonical_id, canonical_state, alias_hit FROM resolved",
    "district_containment": f"""WITH {VARIANTS}, {MASTER_SQL}, n AS (SELECT DISTINCT lower(trim(district)) AS name FROM variants),
 h AS (SELECT name, CASE WHEN name = lower(m.district) THEN 0 ELSE 1 END AS match_level, lower(m.district) AS key, canonical_id, ord
  FROM n JOIN master m ON contains(name, lower(m.district)) OR contains(lower(m.district), name))
 SELECT name, CAST(match_level AS BIGINT) AS match_level, key, canonical_id FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY match_level, ord) AS rn FROM h) WHERE rn = 1""",
    "district_spellings": f"""WITH {VARIANTS}, {S.values('sp', 'ord, spelling, canonical_id', SPELLINGS)},
 v AS (SELECT district FROM variants UNION SELECT {S.case_map('district', DEVANAGARI, 'district')} FROM requests)
 SELECT district, (SELECT min_by(canonical_id, ord) FROM sp WHERE lower(trim(district)) = lower(spelling) OR strip_accents(lower(trim(district))) = lower(spelling)) AS canonical_id FROM v""",
    "district_ranking": f"""WITH {VARIANTS}, {S.values('rd', 'ord, name, state, top_crops, soil_type', RANKED_DISTRICTS)}, {S.values('rs', 'ord, name, top_crops', RANKED_STATES)},
 p AS (SELECT DISTINCT district, trim(state) AS state, lower(trim(district)) AS dk, lower(trim(state)) AS sk FROM variants),
 d AS (SELECT * FROM (SELECT p.*, rd.name, rd.state AS rstate, rd.top_crops, rd.soil_type, CASE WHEN dk = lower(name) THEN 'EXACT' ELSE 'PARTIAL' END AS lv,
  row_number() OVER (PARTITION BY p.district, p.state ORDER BY CASE WHEN dk = lower(name) THEN 0 ELSE 1 END, ord) AS rn FROM p JOIN rd ON contains(dk, lower(name)) OR contains(lower(name), dk)) WHERE rn = 1),
 s AS (SELECT * FROM (SELECT p.*, rs.name, rs.top_crops, row_number() OVER (PARTITION BY p.district, p.state ORDER BY ord) AS rn FROM p JOIN rs ON contains(lower(name), sk)) WHERE rn = 1)
 SELECT p.district, p.state, coalesce(d.lv, 'STATE') AS level, CASE WHEN d.lv IS NOT NULL THEN d.name ELSE p.district END AS district_name, coalesce(d.rstate, s.name) AS found_state,
  coalesce(d.top_crops, s.top_crops) AS top_crops, coalesce(d.soil_type, 'Alluvial Soil') AS soil_type
 FROM p LEFT JOIN d ON d.district = p.district AND d.state = p.state LEFT JOIN s ON s.district = p.district AND s.state = p.state WHERE d.lv IS NOT NULL OR s.name IS NOT NULL""",
    "token_overlap": f"WITH {VARIANTS}, {MASTER_SQL}, {OVERLAP} SELECT state_key, folded, CAST(ord AS BIGINT) AS ord, matched, score FROM overlap",
    "canonical_districts": f"""WITH {RESOLVED}, {MASTER_SQL}, {OVERLAP},
 k AS (SELECT *, lower(canonical_id) AS idk, lower(canonical_name) AS nk, lower(canonical_state) || '::' || lower(canonical_name) AS pk,
  {fold_sql('state')} AS sf, {fold_sql('district')} AS df, {fold_sql("trim(regexp_replace(district, '[(].*?[)]', '', 'g'))")} AS dp FROM resolved),
 mf AS (SELECT *, lower(canonical_id) AS mid, lower(district) AS mn, {fold_sql('state')} AS ms, {fold_sql('district')} AS md FROM master),
 h AS (SELECT k.state, k.district, mf.ord, mf.canonical_id AS ci, mf.state AS cs, mf.district AS cd,
  CASE WHEN idk = mid THEN 1 WHEN pk = mid THEN 2 WHEN nk = mn THEN 3 WHEN sf = ms AND df = md THEN 4 WHEN sf = ms AND dp = md THEN 5 WHEN df = md THEN 6
   WHEN o.ord IS NOT NULL THEN 7 END AS rule FROM k CROSS JOIN mf LEFT JOIN overlap o ON o.state_key = sf AND o.folded = df AND o.ord = mf.ord),
 b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY state, district ORDER BY rule, ord) AS rn FROM h WHERE rule IS NOT NULL) WHERE rn = 1)
 SELECT k.state, k.district, CAST(coalesce(b.rule, 8) AS BIGINT) AS rule, coalesce(ci, canonical_id) AS canonical_id, coalesce(cs, canonical_state) AS canonical_state,
  coalesce(cd, canonical_name) AS canonical_district FROM k LEFT JOIN b ON b.state = k.state AND b.district = k.district""",
    "location_zone": f"""WITH {S.REQUESTS}, n AS (SELECT {_LOC} AS location, count(*) AS requests FROM requests GROUP BY 1)
 SELECT location, requests, coalesce({_contained('lower(trim(location))', dims.ZONE_PLACES, True)}, {_contained('lower(trim(location))', dims.ZONE_STATES, True)}) AS zone FROM n""",
    "location_soil": f"""WITH {S.REQUESTS}, n AS (SELECT {_LOC} AS location, CAST(70.0 AS DOUBLE) + request_id % 12 AS humidity, count(*) AS requests FROM requests GROUP BY 1, 2),
 s AS (SELECT *, {_contained('lower(location)', DISTRICT_SOILS)} AS d, {_contained('lower(location)', STATE_SOILS)} AS t FROM n)
 SELECT location, humidity, requests, coalesce(d, t, 'Alluvial Soil') AS soil_type, CASE WHEN d IS NOT NULL THEN 'district' WHEN t IS NOT NULL THEN 'state' ELSE 'default' END AS matched_by,
 coalesce(d, t, '') = 'Coastal Alluvial Soil' OR {' OR '.join(f"contains(lower(location), '{c}')" for c in COASTAL)} OR humidity > 78 AS is_coastal FROM s""",
    "crop_guidance": f"""WITH {S.CULTIVATION}, {S.values('g', 'key, ord, guidance', GUIDANCE)}, c AS (SELECT crop, count(*) AS facts FROM cultivation GROUP BY 1),
 h AS (SELECT crop, guidance, row_number() OVER (PARTITION BY crop ORDER BY CASE WHEN lower(crop) = key THEN 0 ELSE 1 END, ord) AS rn FROM c JOIN g ON contains(lower(crop), key) OR contains(key, lower(crop)))
 SELECT c.crop, facts, coalesce(guidance, '{DEFAULT_GUIDANCE}' || c.crop || '.') AS guidance FROM c LEFT JOIN h ON h.crop = c.crop AND rn = 1""",
    "crop_labels": f"""WITH {S.CULTIVATION}, {S.values('labels_map', 'k, label', dims.CROP_LABELS.items())},
 n AS (SELECT crop FROM cultivation UNION SELECT upper(p_type[1]) || lower(p_type[2:]) || ' (local)' FROM part UNION SELECT 'Onion (grade ' || p_size || ')' FROM part)
 SELECT n.crop, coalesce(a.label, b.label) AS label, CASE WHEN a.label IS NOT NULL THEN 'exact' WHEN b.label IS NOT NULL THEN 'without_parentheses' ELSE 'excluded' END AS how
 FROM n LEFT JOIN labels_map a ON a.k = lower(trim(n.crop)) LEFT JOIN labels_map b ON b.k = trim(regexp_replace(lower(trim(n.crop)), '[(].*?[)]', '', 'g'))""",
    "unresolved_names": f"""WITH {S.CULTIVATION}, {S.values('labels_map', 'k, label', dims.CROP_LABELS.items())}
 SELECT crop AS name, count(*) AS row_count FROM cultivation WHERE lower(trim(crop)) NOT IN (SELECT k FROM labels_map) GROUP BY 1""",
    "district_page": f"""WITH {S.REQUESTS} SELECT min(request_id) AS ord, {S.initcap('trim(state)')} || '::' || district AS canonical_id, {S.initcap('trim(state)')} AS state, district
 FROM requests GROUP BY ALL ORDER BY ord LIMIT 20""",
    "state_district_page": f"""WITH {S.REQUESTS} SELECT min(request_id) AS ord, {S.initcap('trim(state)')} || '::' || district AS canonical_id, {S.initcap('trim(state)')} AS state, district
 FROM requests WHERE lower(trim(state)) = 'maharashtra' GROUP BY ALL ORDER BY ord LIMIT 100""",
    "sampled_districts": f"""WITH {S.REQUESTS}, d AS (SELECT DISTINCT {S.initcap('trim(state)')} || '::' || district AS canonical_id, {S.initcap('trim(state)')} AS state, district FROM requests),
 t AS (SELECT *, row_number() OVER (ORDER BY md5(canonical_id || '#42'), canonical_id) - 1 AS position FROM d)
 SELECT canonical_id, state, district, CASE position % 4 WHEN 0 THEN 'Kharif' WHEN 1 THEN 'Rabi' WHEN 2 THEN 'Summer' ELSE 'Whole Year' END AS season, position FROM t WHERE position < 20""",
}
