"""Date parsing, age and freshness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from furrow import dims

# Shape of the text of each format and how its parts rearrange to year-month-day;
# the shape keeps a format from reading a longer or shorter text.  Fixed values.
SHAPES = {
    "yyyy-MM-dd": (r"^(\d{4})-(\d{1,2})-(\d{1,2})$", "$1-$2-$3"),
    "dd/MM/yyyy": (r"^(\d{1,2})/(\d{1,2})/(\d{4})$", "$3-$2-$1"),
    "MM/dd/yyyy": (r"^(\d{1,2})/(\d{1,2})/(\d{4})$", "$3-$1-$2"),
    "dd-MM-yyyy": (r"^(\d{1,2})-(\d{1,2})-(\d{4})$", "$3-$2-$1"),
    "yyyy/MM/dd": (r"^(\d{4})/(\d{1,2})/(\d{1,2})$", "$1-$2-$3"),
    "dd.MM.yyyy": (r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$", "$3-$2-$1"),
}


def parse_date(c: Column, formats: Sequence[str] = tuple(dims.QUOTE_DATE_FORMATS)) -> Column:
    """First format that reads the text wins; null when none does.

    The parts are put in year-month-day order and cast, which is far cheaper
    than a formatter per candidate and never raises.
    """
    text = F.trim(c)
    tries = []
    for f in formats:
        shape, order = SHAPES[f]
        tries.append(F.when(text.rlike(shape), F.regexp_replace(text, shape, order).try_cast("date")))
    return F.coalesce(*tries)


def parse_published(c: Column, run_ts: Column) -> Column:
    """RFC-822 with offset or zone name, ISO with offset, or a bare date; else the run time."""
    text = F.trim(c)
    body = F.regexp_replace(text, r"^[A-Za-z]{3}, ", "")
    offset = F.try_to_timestamp(F.when(body.rlike(r"[+-]\d{4}$"), body), F.lit("d MMM yyyy HH:mm:ss Z"))
    zoned = F.try_to_timestamp(
        F.when(body.rlike(r"\d (GMT|UTC)$"), F.regexp_replace(body, r" (GMT|UTC)$", "")),
        F.lit("d MMM yyyy HH:mm:ss"))
    iso = F.try_to_timestamp(F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}T.*([+-]\d{2}:?\d{2}|Z)$"), text))
    plain = F.try_to_timestamp(F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text), F.lit("yyyy-MM-dd"))
    return F.coalesce(offset, zoned, iso, plain, run_ts)


def age_days(as_of: Column, d: Column) -> Column:
    return F.greatest(F.datediff(as_of, d), F.lit(0))


def fractional_age_days(run_ts: Column, ts: Column) -> Column:
    seconds = (F.unix_micros(run_ts) - F.unix_micros(ts)).cast("double") / F.lit(1000000.0)
    days = F.floor(seconds / F.lit(86400.0) * F.lit(10.0) + F.lit(0.5)).cast("double") / F.lit(10.0)
    return F.greatest(F.lit(0.0), days)


def ladder(value: Column, name: str) -> Column:
    """Label of the first step whose limit is not exceeded; null stays null."""
    steps, last = dims.FRESHNESS_LADDERS[name]
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for limit, label in steps:
        out = out.when(value <= F.lit(limit), F.lit(label))
    return out.otherwise(F.lit(last))


def cache_quality(hours: Column) -> Column:
    return F.when(hours < 24, F.lit("fresh")).when(hours < 72, F.lit("stale")).otherwise(F.lit("old"))


def in_any(d: Column, intervals: Sequence[tuple[str, str]]) -> Column:
    """True when the date lies in any closed interval of a fixed list."""
    hit = F.lit(False)
    for start, end in intervals:
        hit = hit | d.between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return hit
