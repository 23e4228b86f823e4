"""The growing daily series as a table partitioned by month.

An increment touches the months of its quotes: it reads these partitions alone and writes each
of them anew as one compact set of files, so neither what it reads nor the number of files
grows with the history.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, LongType, StringType, StructField, StructType

from furrow.operators import prices
from furrow.session import cut_lineage, release
from furrow.sources.files import _exists

STORED = StructType([StructField("ds", DateType()), StructField("crop", StringType()), StructField("state", StringType()),
                     *[StructField(c, LongType()) for c in ("y_cents", "min_cents", "max_cents", "market_count", "range_cents")]])
MONTH = "month"


def month_of(day: Column) -> Column:
    """Name of the partition a day belongs to."""
    return F.date_format(day, "yyyy-MM")


def read_months(spark: SparkSession, table: str, months: Sequence[str] | None = None) -> DataFrame:
    """The stored series, or of the named months only: Spark lists and reads no other partition."""
    if not _exists(spark, table):
        return spark.createDataFrame([], STORED)
    rows = spark.read.schema(StructType([*STORED.fields]).add(MONTH, StringType())).parquet(table)
    return (rows if months is None else rows.where(F.col(MONTH).isin(list(months)))).select(*STORED.names)


def write_months(rows: DataFrame, table: str) -> None:
    """Replace the months that ``rows`` has, each written by one task; other months stay untouched.

    A month is bounded by days x crops x states, so one task can write it.
    """
    typed = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in STORED], month_of(F.col("ds")).alias(MONTH))
    typed.repartition(MONTH).sortWithinPartitions(MONTH, "crop", "state", "ds").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(MONTH).parquet(table)


def merge_increment(quotes: DataFrame, table: str) -> list[str]:
    """Average new quotes per key, append the keys not stored yet, and say which months were written.

    Months in which nothing is new are not written, so a replay changes nothing.  The merged months are
    complete in a table of their own before any stored one is replaced; that table goes once all are.
    """
    spark = quotes.sparkSession
    daily = cut_lineage(prices.daily_rollup(quotes), "increment")
    # A name per month of the increment.
    months = sorted(r[0] for r in daily.select(month_of(F.col("ds"))).distinct().collect())
    stored = read_months(spark, table, months)
    fresh = cut_lineage(prices.new_rows(stored, daily), "fresh")
    touched = sorted(r[0] for r in fresh.select(month_of(F.col("ds"))).distinct().collect())
    if touched:
        merged = cut_lineage(read_months(spark, table, touched).unionByName(fresh.select(*STORED.names)), "merged")
        write_months(merged, table)
        release(merged)
    release(fresh)
    release(daily)
    return touched
