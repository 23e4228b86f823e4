"""Joins of days or moments with the intervals that hold them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType


def bin_of(df: DataFrame, name: str, width: float) -> Column:
    """Number of the bin of ``width`` days that a date or timestamp column falls in."""
    c = F.col(name)
    days = F.unix_date(c).cast("double") if isinstance(df.schema[name].dataType, DateType) else F.unix_micros(c).cast("double") / F.lit(86_400_000_000.0)
    return F.floor(days / F.lit(float(width))).cast("bigint")


def interval_join(points: DataFrame, spans: DataFrame, at: str, start: str = "start_date", end: str = "end_date",
                  keys: Sequence[str] = (), width: float = 32.0) -> DataFrame:
    """Every point with every closed interval that holds it, and that has equal ``keys``.

    An interval is written once for each coarse bin of ``width`` days that it touches, not for each
    day; a point lies in one bin, so a pair meets once and the exact bounds decide.  Both sides
    may be large: it is an equality join on keys and bin, which Spark splits where it is skewed.
    Dates and timestamps alike; intervals that end before they start hold nothing, nulls neither.
    ``width`` is best near the usual length of the intervals.
    """
    clash = set(points.columns) & set(spans.columns) - set(keys)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    bins = F.explode(F.sequence(bin_of(spans, start, width), bin_of(spans, end, width)))
    binned = spans.where(F.col(start) <= F.col(end)).withColumn("_bin", bins)
    placed = points.where(F.col(at).isNotNull()).withColumn("_bin", bin_of(points, at, width))
    return placed.join(binned, [*keys, "_bin"]).where(F.col(at).between(F.col(start), F.col(end))).drop("_bin")


def interval_flags(days: DataFrame, intervals: DataFrame, day: str = "ds") -> DataFrame:
    """Per day: flag and labels of the intervals of a table that contain it."""
    distinct_days = days.select(day).distinct()
    held = interval_join(distinct_days, intervals.select("label", "start_date", "end_date"), day)
    labels = held.groupBy(day).agg(F.array_join(F.array_sort(F.collect_set("label")), ";").alias("labels"))
    return distinct_days.join(labels, day, "left").select(day, F.col("labels").isNotNull().cast("bigint").alias("flag"), "labels")


def calendar_events(days: DataFrame, calendars: DataFrame, day: str = "ds") -> DataFrame:
    """Per day and calendar: whether any event is on, how many, and the first listed one with its factor.

    ``calendars``: calendar, ord, label, start_date, end_date, factor.  Days without an event are absent.
    """
    held = interval_join(days.select(day).distinct(), calendars, day)
    return held.groupBy(day, "calendar").agg(
        F.count(F.lit(1)).alias("events"), F.min_by(F.struct("label", "factor"), "ord").alias("e")).select(
        day, "calendar", "events", F.col("e.label").alias("event_label"), F.col("e.factor").alias("event_factor"))
