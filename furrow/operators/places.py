"""Place and name resolution on distinct names.

Facts carry few distinct names however many rows they have, so every matcher
here works on the distinct names and joins its answer back by equality.
Containment joins on the rarest three letters of the name sought, word overlap on
each name's rarest words; what these equality joins let through is checked exactly.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow import dims
from furrow.functions import text as X


#: Letters of a gram; a shorter name is looked up by all its letters.
GRAM = 3


def grams(c: Column, size: int) -> Column:
    """The different runs of ``size`` characters of a text; found in one pass, so long texts cost in proportion."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{size}}}))"), 1))


def contained_pairs(texts: DataFrame, names: DataFrame) -> DataFrame:
    """Every (text, name) where the name lies in the text; ``texts`` has one column ``text``, ``names`` one ``name``.

    A text is written once for each of its grams, under a hash of it; a name only for the one gram of its own
    that the fewest texts have.  The rows grow with the texts' lengths, and a name meets only
    texts that share its rarest gram.  Empty names and nulls lie nowhere.
    """
    t = texts.where(F.col("text") != "").distinct().withColumn("at", F.xxhash64("text"))
    n = names.where(F.col("name") != "").distinct()
    in_text = t.select("at", F.explode(F.concat(*[grams(F.col("text"), k) for k in range(1, GRAM + 1)])).alias("gram")).distinct()
    size = F.length("name")
    own = F.when(size == 1, grams(F.col("name"), 1)).when(size == 2, grams(F.col("name"), 2)).otherwise(grams(F.col("name"), GRAM))
    held = in_text.groupBy("gram").agg(F.count(F.lit(1)).alias("c"))
    # A gram that no text has counts zero, and its name lies nowhere.
    rarest = n.select("name", F.explode(own).alias("gram")).join(held, "gram", "left").groupBy("name").agg(
        F.min(F.struct(F.coalesce("c", F.lit(0).cast("bigint")).alias("c"), "gram")).alias("m")).where(F.col("m.c") > 0).select("name", F.col("m.gram").alias("gram"))
    near = in_text.join(rarest, "gram").select("at", "name")
    return near.join(t, "at").where(F.col("text").contains(F.col("name"))).select("text", "name")


def match_names(names: DataFrame, master: DataFrame, name: str = "name", key: str = "key", order: str = "ord",
                two_way: bool = True) -> DataFrame:
    """Best master row per distinct name: equal, else contained one way or the other.

    Ties go to the smallest ``order``.  Result: name, match_level (0 equal,
    1 contained) and the master columns; names without a match are absent.
    """
    rest = [c for c in master.columns if c != key]
    n = names.select(F.col(name).alias("q")).where(F.col("q") != "").distinct()
    m = master.where(F.col(key) != "")
    queries, keys = n.select(F.col("q").alias("x")), m.select(F.col(key).alias("x"))
    pairs = contained_pairs(queries.withColumnRenamed("x", "text"), keys.withColumnRenamed("x", "name")).select(F.col("text").alias("q"), F.col("name").alias("k"))
    if two_way:
        pairs = pairs.union(contained_pairs(keys.withColumnRenamed("x", "text"), queries.withColumnRenamed("x", "name")).select(F.col("name").alias("q"), F.col("text").alias("k")))
    entry = F.struct(F.col(key).alias("key"), *rest)
    level = F.when(F.col("q") == F.col(key), 0).otherwise(1)
    found = pairs.join(m, F.col("k") == m[key]).select("q", level.alias("level"), F.col(order).alias("o"), entry.alias("m"))
    best = found.groupBy("q").agg(F.min_by(F.struct("level", "m"), F.struct("level", "o")).alias("b"))
    return best.select(F.col("q").alias(name), F.col("b.level").alias("match_level"), "b.m.*")


def district_info(places: DataFrame, districts: DataFrame, states: DataFrame, district: str = "district", state: str = "state",
                  soil: str = "Alluvial Soil") -> DataFrame:
    """Top crops and soil of each distinct place: its district, one that contains or is contained, else its state.

    ``districts``: ord, name, state, top_crops, soil_type; ``states``: ord, name, top_crops.  The state level takes
    the first listed state that the given name equals or is part of, and keeps the asked district's name.
    Places that neither level knows are absent.
    """
    asked = places.select(F.col(district).alias("q_district"), F.col(state).alias("q_state")).distinct()
    asked = asked.withColumn("d_key", X.key(F.col("q_district"))).withColumn("s_key", X.key(F.col("q_state")))
    by_name = match_names(asked.select(F.col("d_key").alias("name")), districts.select(X.key(F.col("name")).alias("key"), F.struct("name", "state", "top_crops", "soil_type").alias("d"), "ord"))
    listed = states.select(F.struct("ord", "name", "top_crops").alias("s"), X.key(F.col("name")).alias("text"))
    inside = contained_pairs(listed.select("text"), asked.select(F.col("s_key").alias("name")))
    by_state = inside.join(listed, "text").groupBy("name").agg(F.min_by("s", "s.ord").alias("s"))
    a = asked.join(by_name.select(F.col("name").alias("d_key"), "match_level", "d"), "d_key", "left").join(by_state.select(F.col("name").alias("s_key"), "s"), "s_key", "left")
    hit = F.col("d").isNotNull()
    out = a.where(hit | F.col("s").isNotNull())
    return out.select(
        F.col("q_district").alias(district), F.col("q_state").alias(state),
        F.when(hit, F.when(F.col("match_level") == 0, "EXACT").otherwise("PARTIAL")).otherwise("STATE").alias("level"),
        F.when(hit, F.col("d.name")).otherwise(F.col("q_district")).alias("district_name"), F.when(hit, F.col("d.state")).otherwise(F.col("s.name")).alias("found_state"),
        F.when(hit, F.col("d.top_crops")).otherwise(F.col("s.top_crops")).alias("top_crops"), F.when(hit, F.col("d.soil_type")).otherwise(F.lit(soil)).alias("soil_type"))


def alias_frame(spark: SparkSession, aliases: Sequence = tuple(dims.DISTRICT_ALIASES)) -> DataFrame:
    """Every accepted spelling of the renamed districts (a fixed, small table)."""
    rows = {}
    for name, state, spellings in aliases:
        entry = (name, f"{state}::{name}", state)
        for s in [name.lower(), f"{state}::{name}".lower(), *spellings]:
            rows[s] = entry
        for s in spellings:
            rows[f"{state.lower()}::{s}"] = entry
    return dims.frame(spark, [(k, *v) for k, v in rows.items()],
                      "alias string, canonical_name string, canonical_id string, alias_state string")


def resolve_aliases(places: DataFrame, district: str = "district", state: str = "state") -> DataFrame:
    """Canonical name, id and state of each place: alias in its state, alias, else title case."""
    spark = places.sparkSession
    raw, st = X.clean_place(F.col(district)), X.clean_place(F.col(state))
    a = alias_frame(spark)
    one = a.select(F.col("alias").alias("k1"), F.struct("canonical_name", "canonical_id", "alias_state").alias("m1"))
    two = a.select(F.col("alias").alias("k2"), F.struct("canonical_name", "canonical_id", "alias_state").alias("m2"))
    base = places.withColumn("st_clean", st).withColumn("raw_clean", raw).withColumn(
        "st_key", F.when(F.col("st_clean") != "", F.concat("st_clean", F.lit("::"), "raw_clean")))
    j = base.join(one, F.col("st_key") == F.col("k1"), "left").join(two, F.col("raw_clean") == F.col("k2"), "left")
    second = F.when((F.col("st_clean") == "") | (F.lower("m2.alias_state") == F.col("st_clean")), F.col("m2"))
    hit = F.coalesce(F.col("m1"), second)
    title = F.trim(F.regexp_replace(X.title_case(F.trim(F.col(district))), r"(?i)\bDistrict\b", ""))
    own_state = F.coalesce(X.blank_to_null(X.title_case(F.trim(F.col(state)))), F.lit("India"))
    blank = F.coalesce(F.trim(F.col(district)), F.lit("")) == ""
    miss = F.when(blank, F.struct(F.lit("Unknown").alias("canonical_name"), F.lit("Unknown::Unknown").alias("canonical_id"),
                                  F.coalesce(F.col(state), F.lit("Unknown")).alias("alias_state"))).otherwise(
        F.struct(title.alias("canonical_name"), F.concat(own_state, F.lit("::"), title).alias("canonical_id"),
                 own_state.alias("alias_state")))
    r = F.coalesce(hit, miss)
    return j.select(*places.columns, r["canonical_name"].alias("canonical_name"), r["canonical_id"].alias("canonical_id"),
                    r["alias_state"].alias("canonical_state"), hit.isNotNull().alias("alias_hit"))


#: Names that differ only in case or accents are equal, in any script; letters of other scripts stay what they are.
SAME_NAME = "UNICODE_CI_AI"


def resolve_spellings(places: DataFrame, spellings: DataFrame, district: str = "district") -> DataFrame:
    """Canonical id of each distinct name whose spelling is listed, whatever its case, accents or script.

    ``spellings``: spelling, canonical_id, ord.  Names are compared by collation, so nothing is dropped or
    rewritten, and an equality join does it; of several listed spellings the least ``ord`` counts.
    Unlisted, blank and null names have a null id.
    """
    n = places.select(F.col(district).alias("q")).distinct()
    on = F.collate(F.trim("q"), SAME_NAME) == F.collate(F.trim("spelling"), SAME_NAME)
    listed = spellings.where(F.trim("spelling") != "")
    best = n.join(listed, on).groupBy("q").agg(F.min_by("canonical_id", "ord").alias("canonical_id")).withColumnRenamed("q", "b")
    return n.join(best, F.col("q").eqNullSafe(F.col("b")), "left").select(F.col("q").alias(district), "canonical_id")


def token_overlap(names: DataFrame, master: DataFrame, least: float = 0.4) -> DataFrame:
    """Best master name by word overlap (Jaccard of the word sets) within the same state.

    ``names``: state_key, folded; ``master``: state_key, folded, ord.  Words are ranked by how many names
    have them.  Two names alike in ``least`` or more share a word among the rarest
    n - ceil(least n) + 1 of each, so only these are join keys: a word that most names have, such
    as "east", is nearly never one.  Every pair that meets is then measured on its whole word sets.
    """
    def words(df: DataFrame, *keep: str) -> DataFrame:
        w = F.array_distinct(F.filter(F.split("folded", " "), lambda t: t != ""))
        return df.select(*keep, w.alias("words"))

    n = words(names.select("state_key", "folded").distinct(), "state_key", "folded").withColumn("n_id", F.struct("state_key", "folded"))
    m = words(master.select("state_key", "folded", "ord").distinct(), "state_key", "ord", F.col("folded").alias("m_folded")).withColumn("m_id", F.struct("state_key", "ord", "m_folded"))
    single = lambda df, key: df.select("state_key", F.col(key).alias("id"), "words", F.explode("words").alias("word"))
    left, right = single(n, "n_id"), single(m, "m_id")
    held = left.select("word").union(right.select("word")).groupBy("word").agg(F.count(F.lit(1)).alias("c"))

    def rarest(df: DataFrame, out: str) -> DataFrame:
        ranked = df.join(held, "word").groupBy("state_key", "id").agg(F.first("words").alias("words"), F.array_sort(F.collect_list(F.struct("c", "word"))).alias("r"))
        keep = F.size("words") - F.ceil(F.size("words") * F.lit(least) - F.lit(1e-9)).cast("int") + 1
        return ranked.select("state_key", F.col("id").alias(out), F.col("words").alias(f"{out}_words"), F.explode(F.slice("r", F.lit(1), keep)).alias("e")).select(
            "state_key", out, f"{out}_words", F.col("e.word").alias("word"))

    met = rarest(left, "n").join(rarest(right, "m"), ["state_key", "word"]).drop("word")
    shared = F.size(F.array_intersect("n_words", "m_words"))
    score = shared / (F.size("n_words") + F.size("m_words") - shared).cast("double")
    best = met.withColumn("score", score).where(F.col("score") >= least).groupBy("n").agg(
        F.min_by(F.struct("m", "score"), F.struct(-F.col("score"), F.col("m.ord"))).alias("b"))
    return best.select("n.state_key", "n.folded", F.col("b.m.ord").alias("ord"), F.col("b.m.m_folded").alias("matched"), F.col("b.score").alias("score"))


def canonical_districts(places: DataFrame, master: DataFrame, district: str = "district", state: str = "state") -> DataFrame:
    """Master district of each distinct (state, district), by the first rule that answers.

    Rules: canonical id; state and canonical name; canonical name; folded name in
    the state; the same without parentheses; folded name anywhere; word overlap
    in the state; else the alias answer itself.  ``master``: canonical_id, state,
    district, ord.
    """
    base = places.select(F.col(state).alias("q_state"), F.col(district).alias("q_district")).distinct()
    r = resolve_aliases(base, "q_district", "q_state")
    r = r.select(
        "q_state", "q_district", "canonical_name", "canonical_id", "canonical_state",
        F.lower("canonical_id").alias("id_key"), F.lower("canonical_name").alias("name_key"),
        F.concat(F.lower("canonical_state"), F.lit("::"), F.lower("canonical_name")).alias("pair_key"),
        X.fold_place(F.coalesce(X.blank_to_null(F.col("q_state")), F.col("canonical_state"))).alias("st_fold"),
        X.fold_place(F.col("q_district")).alias("d_fold"),
        X.fold_place(X.without_parentheses(F.col("q_district"))).alias("d_plain"))
    m = master.select("ord", "canonical_id", "state", "district", F.lower("canonical_id").alias("m_id"),
                      F.lower("district").alias("m_name"), X.fold_place(F.col("state")).alias("m_state"),
                      X.fold_place(F.col("district")).alias("m_fold"))
    entry = F.struct(F.col("ord"), F.col("m.canonical_id").alias("canonical_id"), F.col("m.state").alias("state"),
                     F.col("m.district").alias("district"))

    def candidate(rank: int, condition: Column) -> DataFrame:
        return r.alias("r").join(m.alias("m"), condition).select(
            "q_state", "q_district", F.lit(rank).alias("rule"), F.col("m.ord").alias("o"), entry.alias("m"))

    c = F.col
    found = candidate(1, c("r.id_key") == c("m.m_id"))
    for rank, condition in [
            (2, c("r.pair_key") == c("m.m_id")), (3, c("r.name_key") == c("m.m_name")),
            (4, (c("r.st_fold") == c("m.m_state")) & (c("r.d_fold") == c("m.m_fold"))),
            (5, (c("r.st_fold") == c("m.m_state")) & (c("r.d_plain") == c("m.m_fold"))),
            (6, c("r.d_fold") == c("m.m_fold"))]:
        found = found.unionByName(candidate(rank, condition))
    overlap = token_overlap(r.select(c("st_fold").alias("state_key"), c("d_fold").alias("folded")),
                            m.select(c("m_state").alias("state_key"), c("m_fold").alias("folded"), "ord"))
    near = r.join(overlap, (r.st_fold == overlap.state_key) & (r.d_fold == overlap.folded)).select(
        "q_state", "q_district", "ord").alias("n").join(m.alias("m"), c("n.ord") == c("m.ord")).select(
        "q_state", "q_district", F.lit(7).alias("rule"), c("m.ord").alias("o"),
        F.struct(c("m.ord"), c("m.canonical_id"), c("m.state"), c("m.district")).alias("m"))
    best = found.unionByName(near).groupBy("q_state", "q_district").agg(
        F.min_by(F.struct("rule", "m"), F.struct("rule", "o")).alias("b"))
    # Blank states and names are keys too, hence the null-safe join.
    b = best.select(c("q_state").alias("b_state"), c("q_district").alias("b_district"), "b")
    out = r.join(b, r.q_state.eqNullSafe(b.b_state) & r.q_district.eqNullSafe(b.b_district), "left")
    return out.select(
        c("q_state").alias(state), c("q_district").alias(district), F.coalesce("b.rule", F.lit(8)).alias("rule"),
        F.coalesce("b.m.canonical_id", "canonical_id").alias("canonical_id"),
        F.coalesce("b.m.state", "canonical_state").alias("canonical_state"),
        F.coalesce("b.m.district", "canonical_name").alias("canonical_district"))


def climate_zone(location: Column, places: Mapping[str, str] = dims.ZONE_PLACES,
                 states: Mapping[str, str] = dims.ZONE_STATES) -> Column:
    """Zone of the longest place name contained in the text, else of the longest state name."""
    text = X.key(location)
    return F.coalesce(X.contained_value(text, places, longest=True), X.contained_value(text, states, longest=True))


def location_soil(location: Column, humidity: Column, district_soils: Mapping[str, str], state_soils: Mapping[str, str],
                  coastal: Sequence[str], default: str = "Alluvial Soil") -> Column:
    """Struct of soil type, how it was found and whether the place counts as coastal."""
    text = X.key(location)
    by_district, by_state = X.contained_value(text, district_soils), X.contained_value(text, state_soils)
    soil = F.coalesce(by_district, by_state, F.lit(default))
    how = F.when(by_district.isNotNull(), "district").when(by_state.isNotNull(), "state").otherwise("default")
    near_sea = F.lit(False)
    for place in coastal:
        near_sea = near_sea | text.contains(place)
    is_coastal = (soil == "Coastal Alluvial Soil") | near_sea | F.coalesce(humidity > 78, F.lit(False))
    return F.struct(soil.alias("soil_type"), how.alias("matched_by"), is_coastal.alias("is_coastal"))


def unresolved_names(rows: DataFrame, known: DataFrame, name: str = "crop", key: str = "alias") -> DataFrame:
    """How often each name without an alias occurs; counted before the anti join."""
    counts = rows.groupBy(F.col(name).alias("name")).agg(F.count(F.lit(1)).alias("row_count"))
    return counts.join(known.select(F.col(key).alias("k")).distinct(), X.key(F.col("name")) == F.col("k"), "left_anti")


def crop_label(name: Column) -> Column:
    """Model label of a crop name: exact, then without parentheses, else null.  A constant-map look-up, no join."""
    text = X.key(name)
    return F.coalesce(X.lookup(text, dims.CROP_LABELS), X.lookup(X.without_parentheses(text), dims.CROP_LABELS))


def crop_labels(names: DataFrame, name: str = "crop") -> DataFrame:
    """Model label of each distinct crop name: exact, then without parentheses, else excluded."""
    n = names.select(F.col(name).alias("crop")).distinct()
    text = X.key(F.col("crop"))
    exact, plain = X.lookup(text, dims.CROP_LABELS), X.lookup(X.without_parentheses(text), dims.CROP_LABELS)
    return n.select("crop", F.coalesce(exact, plain).alias("label"),
                    F.when(exact.isNotNull(), "exact").when(plain.isNotNull(), "without_parentheses").otherwise("excluded").alias("how"))


def list_districts(master: DataFrame, state: str | None = None, limit: int = 100) -> DataFrame:
    """First districts of a state in master order."""
    rows = master if state is None else master.where(F.lower("state") == state.lower())
    return rows.orderBy("ord").limit(limit)


def sampled_districts(master: DataFrame, n: int, seed: int, seasons: Sequence[str] = ("Kharif", "Rabi", "Summer", "Whole Year")) -> DataFrame:
    """A reproducible sample of n districts, each with a season in rotation."""
    from pyspark.sql import Window as W
    mark = F.md5(F.concat(F.col("canonical_id"), F.lit(f"#{seed}")))
    few = master.withColumn("mark", mark).orderBy("mark", "canonical_id").limit(n)
    # At most n rows are left here, so the single-partition numbering is bounded.
    pos = F.row_number().over(W.partitionBy(F.lit(0)).orderBy("mark", "canonical_id")) - 1
    season = F.element_at(F.array(*[F.lit(s) for s in seasons]), (pos % len(seasons) + 1).cast("int"))
    return few.select("canonical_id", "state", "district", season.alias("season"), pos.cast("bigint").alias("position"))
