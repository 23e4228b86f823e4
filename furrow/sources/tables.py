"""Star-schema tables seen as market quotes, requests, articles and signals.

Each function reads only the columns it needs, so the parquet scan prunes the
rest.  No join carries a broadcast hint: table sizes grow with the data, and
Spark picks a broadcast only where its own size statistics allow it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow import dims
from furrow.functions import numeric as N

# ---------------------------------------------------------------- fixed values
# How generic part types, nation keys and market segments stand for crops,
# states and places.
TYPE_CROPS = {"ECONOMY": "Moong (Green Gram)", "LARGE": "Potato", "MEDIUM": "Wheat", "PROMO": "Rice",
              "SMALL": "Maize", "STANDARD": "Onion"}
TYPE_COMMODITIES = {"ECONOMY": "Turmeric", "LARGE": "Potato", "MEDIUM": "Wheat",
                    "PROMO": "Paddy(Dhan)(Common)", "SMALL": "Maize", "STANDARD": "Onion"}
NATION_SPELLINGS = [
    "andhra pradesh", "assam", "bihar", "chattisgarh", "nct of delhi", "goa", "gujarat", "haryana",
    "himachal pradesh", "jharkhand", "karnataka", "kerala", "madhya pradesh", "maharashtra", "manipur",
    "orissa", "pondicherry", "punjab", "rajasthan", "sikkim", "tamil nadu", "telangana", "uttrakhand",
    "west bengal", "newland",
]
SEGMENT_PLACES = {"AUTOMOBILE": "Mysore District", "BUILDING": "Nagpur", "FURNITURE": "Ahmednagar",
                  "HOUSEHOLD": "East Godavari", "MACHINERY": "Kutch"}
REQUEST_SEASONS = ["Kharif", "winter season", "Zaid", "whole year"]
PREVIOUS_CROPS = [None, "Rice", "Wheat", "Groundnut", "Potato", "Moong (Green Gram)"]
SPLIT_DATE = "2001-01-01"
FIXTURE_DISRUPTIONS = [
    ("first", "1996-06-01", "1996-09-30", 1.1),
    ("second", "1998-03-15", "1998-12-31", 1.15),
    ("third", "2000-02-24", "2000-12-31", 1.12),
]
# Words of the invented corpus that stand for event keywords, states and crops.
CORPUS_EVENTS = {"FLOOD": ["thanedble", "ingor"], "DROUGHT": ["edtion", "ndsh"], "HEAVY_RAIN": ["mente"],
                 "PEST_OUTBREAK": ["reble", "whon"], "EXPORT_RESTRICTION": ["hast"], "MSP_POLICY": ["tion"]}
CORPUS_STATES = ["onin", "thanea", "onea", "rely", "innd", "heha", "reaux"]
CORPUS_CROPS = ["aned", "onen", "annd", "inan", "anou", "leaux"]
# -----------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def pick(value: Column, choices: list) -> Column:
    """Element of a fixed list by zero-based position."""
    return F.element_at(F.array(*[F.lit(x) for x in choices]), (value + F.lit(1)).cast("int"))


def quote_lines(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None, keep: Sequence[str] = ("l_orderkey", "l_linenumber")) -> DataFrame:
    """One row per quote with the keys the other views derive from; ``lines`` may be a stream."""
    lines = (table(spark, sf_dir, "lineitem") if lines is None else lines).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
        "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    modal = N.whole(F.col("l_extendedprice") * 100 / F.col("l_quantity"))
    return (lines.join(part, lines.l_partkey == part.p_partkey)
            .join(supplier, lines.l_suppkey == supplier.s_suppkey)
            .join(nation, supplier.s_nationkey == nation.n_nationkey)
            .select(*keep, "p_type", "p_brand", "n_nationkey", "n_name",
                    F.col("l_shipdate").cast("date").alias("ds"), modal.alias("modal_cents"),
                    "l_discount", "l_tax")
            .withColumn("min_cents", N.whole(F.col("modal_cents") * (1 - F.col("l_discount"))))
            .withColumn("max_cents", N.whole(F.col("modal_cents") * (1 + F.col("l_tax")))))


def quotes(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """Clean quotes: ds, crop, state, market and prices in whole cents."""
    return quote_lines(spark, sf_dir, lines).select(
        "ds", F.lower("p_type").alias("crop"), F.col("n_name").alias("state"),
        F.col("p_brand").alias("market"), "modal_cents", "min_cents", "max_cents")


def price_text(c: Column) -> Column:
    """Cents as text with two decimals."""
    return F.format_string("%d.%02d", F.floor(c / 100), c % 100)


def raw_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes as they arrive: all text, three date formats, blanks, bad signs, swapped bounds."""
    swapped = F.col("l_orderkey") % 83 == 0
    commodity = F.element_at(F.create_map(*[F.lit(x) for kv in TYPE_COMMODITIES.items() for x in kv]), F.col("p_type"))
    # Cents are settled one level below their text, so each is computed once.
    q = quote_lines(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", "p_brand", "n_nationkey", "ds", commodity.alias("Commodity"), "modal_cents",
        F.when(swapped, F.col("max_cents")).otherwise(F.col("min_cents")).alias("low"),
        F.when(swapped, F.col("min_cents")).otherwise(F.col("max_cents")).alias("high"))
    day = (F.when(F.col("l_linenumber") % 3 == 0, F.date_format("ds", "yyyy-MM-dd"))
           .when(F.col("l_linenumber") % 3 == 1, F.date_format("ds", "dd/MM/yyyy"))
           .otherwise(F.date_format("ds", "dd-MM-yyyy")))
    modal = (F.when(F.col("l_orderkey") % 97 == 0, F.lit(""))
             .when(F.col("l_orderkey") % 89 == 0, F.concat(F.lit("-"), price_text(F.col("modal_cents"))))
             .otherwise(price_text(F.col("modal_cents"))))
    return q.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("bigint").alias("quote_id"),
        F.concat(F.lit("  "), F.upper(pick(F.col("n_nationkey"), NATION_SPELLINGS)), F.lit(" ")).alias("State"),
        "Commodity", F.col("p_brand").alias("Market"), day.alias("Arrival_Date"),
        F.when(F.col("l_orderkey") % 79 == 0, F.lit("")).otherwise(price_text(F.col("low"))).alias("Min_Price"),
        price_text(F.col("high")).alias("Max_Price"), modal.alias("Modal_Price"))


def climate_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly climate stand-in: mean order value and number of orders."""
    orders = table(spark, sf_dir, "orders").select("o_orderdate", "o_totalprice")
    return (orders.groupBy(F.year("o_orderdate").cast("bigint").alias("year"),
                     F.month("o_orderdate").cast("bigint").alias("month"))
            .agg(F.sum(N.cents(F.col("o_totalprice"))).alias("total_cents"), F.count(F.lit(1)).alias("n"))
            .select("year", "month",
                    (F.col("total_cents").cast("double") / F.col("n") / F.lit(1000000.0)).alias("avg_temp"),
                    F.col("n").cast("double").alias("total_rainfall")))


def articles_raw(spark: SparkSession, sf_dir: str, documents: DataFrame | None = None) -> DataFrame:
    """Documents as feed items: first line is the headline, the rest the description."""
    d = (table(spark, sf_dir, "documents") if documents is None else documents).select("doc_id", "text", "source")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 90).cast("int"))
    ts = F.timestamp_seconds(F.unix_date(day).cast("bigint") * 86400 + (F.col("doc_id") % 24) * 3600)
    stamp = (F.when(F.col("doc_id") % 17 == 0, F.lit("n/a"))
             .when(F.col("doc_id") % 4 == 0, F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss '+0530'"))
             .when(F.col("doc_id") % 4 == 1, F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss 'GMT'"))
             .when(F.col("doc_id") % 4 == 2, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'"))
             .otherwise(F.date_format(ts, "yyyy-MM-dd")))
    line_end = F.instr("text", "\n")
    return d.select(
        "doc_id",
        F.when(line_end > 0, F.substring(F.col("text"), F.lit(1), line_end - 1)).otherwise(F.col("text")).alias("title"),
        F.when(line_end > 0, F.substring(F.col("text"), line_end + 1, F.length("text"))).otherwise(F.lit("")).alias("description"),
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("link"), stamp.alias("pub_date"),
        F.col("source").alias("source_id"),
        F.concat(F.lit("Outlet "), F.col("source")).alias("source_name"),
        F.concat(F.lit("TIER_"), (F.regexp_extract("source", "([0-9]+)", 1).cast("bigint") % 4 + 1).cast("string")).alias("tier"))


def signals(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Event stream as news signals of a state and a crop."""
    e = (table(spark, sf_dir, "events") if events is None else events).select("event_id", "ts", "user_id", "event_type", "value", "props")
    k = F.get_json_object("props", "$.k").cast("bigint")
    source = F.col("user_id") % 7
    return e.select(
        "event_id", "ts",
        F.concat(F.lit("S"), (k % 20).cast("string")).alias("state"),
        pick(F.col("user_id") % 6, list(TYPE_CROPS.values())).alias("crop"),
        F.concat(F.lit("source "), source.cast("string")).alias("source_name"),
        pick(source, ["TIER_1_OFFICIAL", "TIER_2_AGRI_RESEARCH", "TIER_3_BUSINESS_MARKET", "TIER_4_GENERAL_MEDIA",
                      "TIER_1_OFFICIAL", "TIER_4_GENERAL_MEDIA", "DISCOVERY_ONLY"]).alias("tier"),
        pick(source, [1.0, 0.8, 0.6, 0.4, 1.0, 0.4, 0.2]).alias("credibility_weight"),
        F.create_map(F.lit("click"), F.lit("RISK_DECREASED"), F.lit("error"), F.lit("RISK_INCREASED"),
                     F.lit("purchase"), F.lit("RISK_ELEVATED"), F.lit("signup"), F.lit("NEUTRAL"),
                     F.lit("view"), F.lit("NEGATIVE"))[F.col("event_type")].alias("direction"),
        F.datediff(F.lit("2024-03-15").cast("date"), F.col("ts").cast("date")).cast("bigint").alias("age_days"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Advice requests: one per customer."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    return c.select(
        F.col("c_custkey").alias("request_id"),
        F.concat(F.lit(" "), F.upper(pick(F.col("c_nationkey"), NATION_SPELLINGS))).alias("state"),
        F.element_at(F.create_map(*[F.lit(x) for kv in SEGMENT_PLACES.items() for x in kv]),
                     F.col("c_mktsegment")).alias("district"),
        pick(F.col("c_custkey") % 4, REQUEST_SEASONS).alias("season"),
        F.when(F.col("c_custkey") % 7 != 0, F.lit(4.0) + (F.col("c_custkey") % 50) / F.lit(10.0)).alias("soil_ph"),
        F.when(F.col("c_custkey") % 5 != 0, F.greatest(F.col("c_acctbal"), F.lit(0.0))).alias("water_available_mm"),
        pick(F.col("c_custkey") % 6, PREVIOUS_CROPS).alias("previous_crop"),
        (F.col("c_custkey") % 320).cast("double").alias("n"), (F.col("c_custkey") % 90).cast("double").alias("p"),
        (F.col("c_custkey") % 110).cast("double").alias("k"),
        (F.lit(8.0) + (F.col("c_custkey") % 27)).alias("lat"), (F.lit(69.0) + (F.col("c_custkey") % 28)).alias("lon"))


def cultivation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cultivation facts: district, state, crop, year, season and production."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    month = F.month("o_orderdate")
    crop = F.element_at(F.create_map(*[F.lit(x) for kv in TYPE_CROPS.items() for x in kv]), F.col("p_type"))
    by_month = F.when(month.isin(6, 7, 8, 9, 10), "Kharif").when(month.isin(4, 5), "Summer").otherwise("Rabi")
    season = F.when(F.col("crop").isin("Wheat", "Potato"), "Rabi").when(F.col("crop") == "Rice", "Kharif").otherwise(F.col("by_month"))
    rows = (lines.join(orders, lines.l_orderkey == orders.o_orderkey)
            .join(cust, orders.o_custkey == cust.c_custkey)
            .join(part, lines.l_partkey == part.p_partkey)
            .select(
                F.element_at(F.create_map(*[F.lit(x) for kv in SEGMENT_PLACES.items() for x in kv]),
                             F.col("c_mktsegment")).alias("district"),
                pick(F.col("c_nationkey"), NATION_SPELLINGS).alias("state"), crop.alias("crop"),
                F.year("o_orderdate").cast("bigint").alias("crop_year"), by_month.alias("by_month"),
                F.col("l_quantity").cast("bigint").alias("production")))
    return rows.select("district", "state", "crop", "crop_year", season.alias("season"), "production")


def class_rows(spark: SparkSession, sf_dir: str, features: int = 7) -> DataFrame:
    """Labelled rows with the first vector elements as features."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("label").cast("string").alias("label"),
                    *[F.element_at("embedding", i + 1).cast("double").alias(f"f{i}") for i in range(features)])
