"""File sources and sinks: archives, reference documents, series, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from furrow import schemas
from furrow.functions import numeric as N
from furrow.operators.prices import STORE_COLUMNS


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_archive(spark: SparkSession, folder: str, years: Sequence[int] = tuple(range(2019, 2025))) -> DataFrame:
    """Yearly quote files as text columns; absent years are skipped, bad bytes are replaced by the decoder."""
    paths = [p for p in (f"{folder.rstrip('/')}/{y}.csv" for y in years) if _exists(spark, p)]
    if not paths:
        return spark.createDataFrame([], schemas.ARCHIVE)
    return (spark.read.option("header", True).option("mode", "PERMISSIVE").option("enforceSchema", False)
            .schema(schemas.ARCHIVE).csv(paths))


def read_quote_json(spark: SparkSession, path: str) -> DataFrame:
    """Landed quote records, one JSON object per line, whatever spelling their fields use."""
    return spark.read.json(path, primitivesAsString=True)


def read_series(spark: SparkSession, path: str) -> DataFrame:
    """Stored daily series, typed by schema; sort only where an output needs it."""
    return spark.read.schema(schemas.DAILY_SERIES).parquet(path)


def read_series_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema(schemas.DAILY_SERIES).csv(path)


def series_in_cents(series: DataFrame) -> DataFrame:
    """Rupee columns of a stored series as the whole cents the operators work on."""
    return series.select(
        "ds", "crop", "state", N.cents(F.col("y")).alias("y_cents"), N.cents(F.coalesce("min_price", F.lit(0.0))).alias("min_cents"),
        N.cents(F.coalesce("max_price", F.lit(0.0))).alias("max_cents"), "market_count",
        N.cents(F.coalesce("price_range", F.lit(0.0))).alias("range_cents"))


def append_series(rows: DataFrame, path: str) -> None:
    """Append in the fixed columns and types, partitioned by crop.

    Absent measures get the zero of their type; the keys and the price must be there.  An absent
    seven-row deviation is worked out from the rows given.
    """
    have, kinds = set(rows.columns), {f.name: f.dataType for f in schemas.DAILY_SERIES}
    absent = [c for c in ("ds", "crop", "state", "y") if c not in have]
    if absent:
        raise ValueError(f"a stored series needs {', '.join(absent)}")
    if "rolling_std_7" not in have:
        seven = Window.partitionBy("crop", "state").orderBy("ds").rowsBetween(-6, 0)
        rows = rows.withColumn("rolling_std_7", F.coalesce(F.stddev_samp("y").over(seven), F.lit(0.0)))
        have.add("rolling_std_7")
    ordered = [(F.col(c) if c in have else F.lit(0)).cast(kinds[c]).alias(c) for c in STORE_COLUMNS]
    rows.select(*ordered).write.mode("append").partitionBy("crop").parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    """One-row report as a single JSON document."""
    report.coalesce(1).write.mode("overwrite").json(path)


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A multi-line JSON reference document under a declared schema."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def requirements_rows(doc: DataFrame) -> DataFrame:
    r = doc.select(F.explode("crop_requirements").alias("crop", "r"))
    return r.select("crop", "r.soil_ph", "r.temperature_c", "r.duration_days", "r.suitable_soils")


def soil_map_rows(doc: DataFrame) -> DataFrame:
    """District and state soil types as rows: kind, name, soil_type, ord (districts first)."""
    d = doc.select(F.explode("districts").alias("name", "soil_type")).withColumn("kind", F.lit("district"))
    s = doc.select(F.explode("states").alias("name", "soil_type")).withColumn("kind", F.lit("state"))
    return d.unionByName(s)


def event_rows(doc: DataFrame) -> DataFrame:
    """External events, one row per affected crop, with typed dates."""
    e = doc.select(F.explode("external_events").alias("e")).select("e.*")
    return e.select("event_id", "event_type", F.explode("affected_crops").alias("crop"), "affected_scope",
                    F.col("start_date").cast("date").alias("start_date"), F.col("end_date").cast("date").alias("end_date"), "severity_level")


def candidate_rows(doc: DataFrame) -> DataFrame:
    return doc.select("state", "district", "season", F.inline("candidates"))
