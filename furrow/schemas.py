"""Declared schemas of landed data."""

from __future__ import annotations

from pyspark.sql import types as T

# Columns of the yearly archive, all text.  Fixed values.
ARCHIVE_COLUMNS = ["State", "District", "Market", "Commodity", "Variety", "Grade", "Arrival_Date", "Min_Price", "Max_Price",
                   "Modal_Price", "Commodity_Code"]
ARCHIVE = T.StructType([T.StructField(c, T.StringType()) for c in ARCHIVE_COLUMNS])

DAILY_SERIES = T.StructType([
    T.StructField("ds", T.DateType()), T.StructField("crop", T.StringType()), T.StructField("state", T.StringType()),
    T.StructField("y", T.DoubleType()), T.StructField("min_price", T.DoubleType()), T.StructField("max_price", T.DoubleType()),
    T.StructField("market_count", T.LongType()), T.StructField("price_range", T.DoubleType()), T.StructField("rolling_std_7", T.DoubleType())])

CLIMATE = T.StructType([
    T.StructField("year", T.LongType()), T.StructField("month", T.LongType()), T.StructField("avg_temp", T.DoubleType()),
    T.StructField("total_rainfall", T.DoubleType())])

_SOURCE = "struct<source_id: string, source_name: string, tier: string, rss_url: string, google_news_query: string, topics: array<string>>"
REGISTRY = f"credibility_tiers map<string, struct<sources: array<{_SOURCE}>>>"
CROP_REQUIREMENTS = ("crop_requirements map<string, struct<soil_ph: struct<min: double, max: double, optimal: double>, "
                     "temperature_c: struct<min: double, max: double, optimal: double>, "
                     "duration_days: struct<min: double, max: double, average: double>, suitable_soils: array<string>>>")
DISRUPTIONS = "events array<struct<label: string, start_date: string, end_date: string, factor: double>>"
EXTERNAL_EVENTS = ("external_events array<struct<event_id: string, event_name: string, event_type: string, affected_crops: array<string>, "
                   "affected_scope: string, start_date: string, end_date: string, severity_level: int>>")
TOLERANCES = ("crop string, suitable_soils array<string>, min_temp double, max_temp double, min_rain double, max_rain double")
DISTRICTS = "canonical_id string, state string, district string, source_names array<string>"
SOIL_MAP = "districts map<string, string>, states map<string, string>, coastal_districts array<string>"
CANDIDATES = ("state string, district string, season string, candidates array<struct<crop: string, evidence_score: double, "
              "data_confidence: double, source: string>>")
