"""Feature, split and tail queries over the daily series."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow import dims
from furrow.operators import features as ft
from furrow.operators import intervals as iv
from furrow.operators import prices
from furrow.plans import sql as S
from furrow.plans.prices import daily, stored_daily
from furrow.sources import tables as T

SPANS = [(a, b) for _, a, b, _ in T.FIXTURE_DISRUPTIONS]
CORRELATED = ["y", "lag_1", "lag_7", "lag_30", "rolling_7", "rolling_30", "rolling_std_7", "price_range", "month"]
EXTERNAL_EVENTS = [("E1", "EXPORT_RESTRICTION", ["promo", "small"], "NATIONAL", "1996-03-01", "1996-04-15"),
                   ("E2", "SUBSIDY", ["promo", "medium", "large"], "NATIONAL", "1997-06-01", "1997-07-31"),
                   ("E3", "FLOOD", ["economy"], "NATION_3", "1997-07-01", "1997-07-20")]


def series_features(spark, sf):
    return ft.encoded_features(stored_daily(spark, sf), SPANS)


def leakage_check(spark, sf):
    return ft.leakage_check(ft.lag_features(daily(spark, sf), SPANS))


def feature_correlation(spark, sf):
    return prices.correlations(ft.lag_features(daily(spark, sf), SPANS), CORRELATED)


def cascade_features(spark, sf):
    return ft.cascade_features(daily(spark, sf), T.climate_history(spark, sf), SPANS)


def climate_lookup(spark, sf):
    months = daily(spark, sf).select(F.year("ds").cast("bigint").alias("year"), F.month("ds").cast("bigint").alias("month")).distinct()
    return ft.climate_lookup(months, T.climate_history(spark, sf)).select("year", "month", "avg_temp", "total_rainfall", "climate_level")


def disruption_events(spark, sf):
    days = daily(spark, sf).groupBy("ds").agg(F.sum("market_count").alias("quotes"))
    return ft.first_event(days, T.FIXTURE_DISRUPTIONS)


def external_event_days(spark, sf):
    """Series rows per external event that names their crop and covers their day and state."""
    ev = spark.createDataFrame(EXTERNAL_EVENTS, "event_id string, event_type string, crops array<string>, scope string, start_date string, end_date string")
    spans = ev.select("event_id", "event_type", "scope", F.explode("crops").alias("crop"), F.col("start_date").cast("date").alias("start_date"), F.col("end_date").cast("date").alias("end_date"))
    held = iv.interval_join(daily(spark, sf), spans, "ds", keys=["crop"])
    hits = held.where((F.col("scope") == "NATIONAL") | (F.col("scope") == F.col("state")))
    return hits.groupBy("event_id", "event_type", "crop").agg(
        F.count(F.lit(1)).alias("series_days"), F.sum("market_count").alias("quotes"), F.max("y_cents").alias("peak_cents"))


def interval_flags(spark, sf):
    spans = spark.createDataFrame([(n, a, b) for n, a, b, _ in T.FIXTURE_DISRUPTIONS] + [("overlap", "1998-06-01", "1998-06-30")],
                                  "label string, a string, b string")
    spans = spans.select("label", F.col("a").cast("date").alias("start_date"), F.col("b").cast("date").alias("end_date"))
    return iv.interval_flags(daily(spark, sf).select("ds"), spans)


#: Years from the quotes to the published calendars.
SHIFT_YEARS = 23


def calendar_events(spark, sf):
    """The published calendars over the days of the series, moved into the calendars' years."""
    rows = [(c, i, label, a, b, f) for i, (c, label, a, b, f) in enumerate(dims.DISRUPTIONS)]
    spans = spark.createDataFrame(rows, "calendar string, ord bigint, label string, a string, b string, factor double").select(
        "calendar", "ord", "label", F.col("a").cast("date").alias("start_date"), F.col("b").cast("date").alias("end_date"), "factor")
    return iv.calendar_events(daily(spark, sf).select(F.add_months("ds", 12 * SHIFT_YEARS).alias("ds")), spans)


def strict_rolling(spark, sf):
    return ft.strict_rolling(daily(spark, sf))


def chronological_split(spark, sf):
    parts = ft.chronological_split(ft.lag_features(daily(spark, sf), SPANS), T.SPLIT_DATE)
    return parts.groupBy("crop", "part").agg(F.count(F.lit(1)).alias("row_count"), F.min("ds").alias("first_day"), F.max("ds").alias("last_day"))


def positional_split(spark, sf):
    """A cut after the last day leaves no test rows, so each crop is cut at 80 percent of its rows."""
    parts = ft.chronological_split(ft.lag_features(daily(spark, sf), SPANS), "2030-01-01")
    return parts.groupBy("crop", "part").agg(F.count(F.lit(1)).alias("row_count"), F.min("ds").alias("first_day"), F.max("ds").alias("last_day"))


def last_rows_split(spark, sf):
    parts = ft.last_rows_split(daily(spark, sf), 60)
    return parts.groupBy("crop", "state", "part").agg(F.count(F.lit(1)).alias("row_count"), F.min("ds").alias("first_day"))


def series_tail(spark, sf):
    t = ft.series_tail(daily(spark, sf), 60)
    line = F.transform("tail", lambda r: F.concat_ws("=", F.date_format(r["ds"], "yyyy-MM-dd"), r["y_cents"].cast("string")))
    return t.select("crop", "state", F.size("tail").cast("bigint").alias("tail_rows"), F.array_join(line, ",").alias("tail"))


def daily_change(spark, sf):
    return ft.daily_change(daily(spark, sf))


def calendar_dense(spark, sf):
    d = ft.calendar_dense(daily(spark, sf))
    return d.groupBy("crop", "state").agg(F.count(F.lit(1)).alias("days"), F.count("y_cents").alias("days_with_price"))


QUERIES = {f.__name__: f for f in [
    series_features, leakage_check, feature_correlation, cascade_features, climate_lookup, disruption_events,
    external_event_days, interval_flags, calendar_events, strict_rolling, chronological_split, positional_split, last_rows_split,
    series_tail, daily_change, calendar_dense]}

# ------------------------------------------------------------------ check SQL
IN_SPAN = " OR ".join(f"ds BETWEEN DATE '{a}' AND DATE '{b}'" for a, b in SPANS)


def _mean(k: int) -> str:
    f = f"(PARTITION BY crop, state ORDER BY ds ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"
    return f"CAST(CAST(sum(y_cents) OVER {f} AS BIGINT) AS DOUBLE) / count(y_cents) OVER {f} / CAST(100.0 AS DOUBLE)"


_F7 = "(PARTITION BY crop, state ORDER BY ds ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)"
FEATURES = S.DAILY + f""",
wide AS (SELECT *, {', '.join(f"lag(y_cents, {k}) OVER (PARTITION BY crop, state ORDER BY ds) AS l{k}" for k in (1, 7, 14, 30))},
 {_mean(7)} AS rolling_7, {_mean(30)} AS rolling_30,
 CAST(count(y_cents) OVER {_F7} AS DOUBLE) AS n7, CAST(CAST(sum(y_cents) OVER {_F7} AS BIGINT) AS DOUBLE) AS s7,
 CAST(CAST(sum(y_cents * y_cents) OVER {_F7} AS BIGINT) AS DOUBLE) AS q7, count(*) OVER (PARTITION BY crop, state) AS series_rows FROM daily),
feats AS (SELECT crop, state, ds, {S.rs('y_cents')} AS y, {', '.join(f"{S.rs(f'l{k}')} AS lag_{k}" for k in (1, 7, 14, 30))}, rolling_7, rolling_30,
 CASE WHEN n7 > 1 THEN sqrt(greatest(n7 * q7 - s7 * s7, 0) / (n7 * (n7 - 1))) / CAST(100.0 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS rolling_std_7,
 {S.rs('range_cents')} AS price_range, dayofyear(ds) AS day_of_year, month(ds) AS month, isodow(ds) - 1 AS day_of_week, year(ds) AS year,
 CAST(CASE WHEN {IN_SPAN} THEN 1 ELSE 0 END AS BIGINT) AS black_swan
 FROM wide WHERE series_rows >= 15 AND l1 IS NOT NULL AND l7 IS NOT NULL AND l14 IS NOT NULL AND l30 IS NOT NULL)"""

_PAIRS = [(a, b) for i, a in enumerate(CORRELATED) for b in CORRELATED[i + 1:]]
_LEVELS = S.CLIMATE + f""", m AS (SELECT month, CAST(CAST(sum({S.whole('avg_temp * 1000000.0')}) AS BIGINT) AS DOUBLE) / count(*) / 1000000.0 AS t,
 CAST(CAST(sum({S.whole('total_rainfall * 1000000.0')}) AS BIGINT) AS DOUBLE) / count(*) / 1000000.0 AS r FROM climate GROUP BY 1),
 g AS (SELECT CAST(CAST(sum({S.whole('avg_temp * 1000000.0')}) AS BIGINT) AS DOUBLE) / count(*) / 1000000.0 AS t,
 CAST(CAST(sum({S.whole('total_rainfall * 1000000.0')}) AS BIGINT) AS DOUBLE) / count(*) / 1000000.0 AS r FROM climate)"""
_CLIMATE_COLS = ("coalesce(c.avg_temp, m.t, g.t) AS avg_temp, coalesce(c.total_rainfall, m.r, g.r) AS total_rainfall, "
                 "CASE WHEN c.avg_temp IS NOT NULL THEN 'YEAR_MONTH' ELSE 'MONTH' END AS climate_level")
_CLIMATE_JOIN = "LEFT JOIN climate c ON c.year = x.year AND c.month = x.month LEFT JOIN m ON m.month = x.month CROSS JOIN g"
_EVENT_ROWS = [(e, t, c, s, a, b) for e, t, cs, s, a, b in EXTERNAL_EVENTS for c in cs]
_CODES = "codes AS (SELECT crop, state, dense_rank() OVER (PARTITION BY crop ORDER BY state) - 1 AS state_enc FROM (SELECT DISTINCT crop, state FROM feats))"


def _split_sql(cut: str) -> str:
    return f"""WITH {FEATURES}, h AS (SELECT crop, max(CASE WHEN ds >= DATE '{cut}' THEN 1 ELSE 0 END) AS has_test, count(*) AS n FROM feats GROUP BY 1),
 u AS (SELECT f.*, h.has_test, h.n, count(*) OVER (PARTITION BY f.crop ORDER BY ds RANGE UNBOUNDED PRECEDING) AS upto FROM feats f JOIN h ON h.crop = f.crop)
 SELECT crop, CASE WHEN CASE WHEN has_test = 1 THEN ds >= DATE '{cut}' ELSE upto > floor(n * CAST(0.8 AS DOUBLE)) END THEN 'test' ELSE 'train' END AS part,
 count(*) AS row_count, min(ds) AS first_day, max(ds) AS last_day FROM u GROUP BY 1, 2"""


ORACLES = {
    "series_features": f"WITH {FEATURES}, {_CODES} SELECT f.*, c.state_enc FROM feats f JOIN codes c ON c.crop = f.crop AND c.state = f.state",
    "leakage_check": f"""WITH {FEATURES}, t AS (SELECT count(*) AS rows_checked, CAST(CAST(sum(abs({S.whole('lag_1 * 100.0')} - {S.whole('y * 100.0')})) AS BIGINT) AS DOUBLE) / count(*) / 100.0 AS mean_abs_diff FROM feats)
 SELECT *, CASE WHEN mean_abs_diff = 0 THEN 'FAILED' ELSE 'SAFE_NO_LEAKAGE' END AS leakage_status FROM t""",
    "feature_correlation": f"WITH {FEATURES}, c AS MATERIALIZED (SELECT crop, " + ", ".join(
        f"corr({a}, {b}) AS r{i}" for i, (a, b) in enumerate(_PAIRS)) + " FROM feats GROUP BY 1) " + " UNION ALL ".join(
        f"SELECT crop, '{a}' AS feature_a, '{b}' AS feature_b, {S.rnd(f'r{i}', 6)} AS correlation FROM c" for i, (a, b) in enumerate(_PAIRS)),
    "cascade_features": f"""WITH {S.DAILY}, {_LEVELS},
 x AS (SELECT *, row_number() OVER w AS rn, coalesce(lag(y_cents, 1) OVER w, y_cents) AS l1, lag(y_cents, 7) OVER w AS a7, lag(y_cents, 14) OVER w AS a14,
  lag(y_cents, 30) OVER w AS a30, coalesce({_mean(7)}, {S.rs('y_cents')}) AS m7, coalesce({_mean(30)}, {S.rs('y_cents')}) AS m30,
  month(ds) AS month, year(ds) AS year FROM daily WINDOW w AS (PARTITION BY crop, state ORDER BY ds))
 SELECT crop, state, ds, {S.rs('y_cents')} AS y, {S.rs('l1')} AS lag_1, {S.rs('coalesce(a7, l1)')} AS lag_7, {S.rs('coalesce(a14, a7, l1)')} AS lag_14,
  {S.rs('coalesce(a30, a14, a7, l1)')} AS lag_30, {S.rnd('m7', 2)} AS rolling_mean_7, {S.rnd('m30', 2)} AS rolling_mean_30, x.month AS month,
  CAST(CASE WHEN x.month IN (6,7,8,9,10) THEN 0 WHEN x.month IN (11,12,1,2,3) THEN 1 ELSE 2 END AS BIGINT) AS season,
  {S.rnd('coalesce(c.avg_temp, m.t, g.t)', 2)} AS monthly_avg_temp, {S.rnd('coalesce(c.total_rainfall, m.r, g.r)', 2)} AS monthly_total_rainfall,
  CAST(CASE WHEN {IN_SPAN} THEN 1 ELSE 0 END AS BIGINT) AS black_swan FROM x {_CLIMATE_JOIN} WHERE rn > 30""",
    "climate_lookup": f"WITH {S.DAILY}, {_LEVELS}, x AS (SELECT DISTINCT year(ds) AS year, month(ds) AS month FROM daily) SELECT x.year, x.month, {_CLIMATE_COLS} FROM x {_CLIMATE_JOIN}",
    "disruption_events": f"""WITH {S.QUOTES} SELECT ds, count(*) AS quotes, CASE {' '.join(f"WHEN ds BETWEEN DATE '{a}' AND DATE '{b}' THEN '{n}'" for n, a, b, _ in T.FIXTURE_DISRUPTIONS)} END AS event_label,
 CASE {' '.join(f"WHEN ds BETWEEN DATE '{a}' AND DATE '{b}' THEN {S.lit(f)}" for n, a, b, f in T.FIXTURE_DISRUPTIONS)} END AS event_factor FROM quotes GROUP BY 1""",
    "external_event_days": f"""WITH {S.DAILY}, {S.values('ev', 'event_id, event_type, crop, scope, a, b', _EVENT_ROWS)}
 SELECT event_id, event_type, d.crop, count(*) AS series_days, CAST(sum(market_count) AS BIGINT) AS quotes, max(y_cents) AS peak_cents
 FROM daily d JOIN ev ON ev.crop = d.crop AND d.ds BETWEEN CAST(a AS DATE) AND CAST(b AS DATE) AND (scope = 'NATIONAL' OR scope = d.state) GROUP BY 1, 2, 3""",
    "interval_flags": f"""WITH {S.DAILY}, {S.values('sp', 'label, a, b', [(n, a, b) for n, a, b, _ in T.FIXTURE_DISRUPTIONS] + [('overlap', '1998-06-01', '1998-06-30')])},
 d AS (SELECT DISTINCT ds FROM daily) SELECT ds, CAST(max(CASE WHEN label IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS flag, string_agg(label, ';' ORDER BY label) AS labels
 FROM d LEFT JOIN sp ON ds BETWEEN CAST(a AS DATE) AND CAST(b AS DATE) GROUP BY 1""",
    "calendar_events": f"""WITH {S.DAILY}, {S.values('sp', 'calendar, ord, label, a, b, factor', [(c, i, n, a, b, f) for i, (c, n, a, b, f) in enumerate(dims.DISRUPTIONS)])},
 d AS (SELECT DISTINCT CAST(ds + INTERVAL {SHIFT_YEARS} YEAR AS DATE) AS ds FROM daily)
 SELECT ds, calendar, count(*) AS events, min_by(label, ord) AS event_label, min_by(factor, ord) AS event_factor FROM d JOIN sp ON ds BETWEEN CAST(a AS DATE) AND CAST(b AS DATE) GROUP BY 1, 2""",
    "strict_rolling": f"""WITH {S.DAILY}, w AS (SELECT *, {', '.join(f"lag(y_cents, {k}) OVER (PARTITION BY crop, state ORDER BY ds) AS l{k}" for k in (1, 7, 14, 30))},
 {_mean(7)} AS m7, {_mean(30)} AS m30, row_number() OVER (PARTITION BY crop, state ORDER BY ds) AS rn FROM daily)
 SELECT crop, state, ds, {S.rs('y_cents')} AS y, {', '.join(f"{S.rs(f'l{k}')} AS lag_{k}" for k in (1, 7, 14, 30))}, m7 AS rolling_mean_7, m30 AS rolling_mean_30 FROM w WHERE rn > 30""",
    "chronological_split": _split_sql(T.SPLIT_DATE),
    "positional_split": _split_sql("2030-01-01"),
    "last_rows_split": f"""WITH {S.DAILY}, r AS (SELECT *, row_number() OVER (PARTITION BY crop, state ORDER BY ds DESC) AS back FROM daily)
 SELECT crop, state, CASE WHEN back <= 60 THEN 'test' ELSE 'train' END AS part, count(*) AS row_count, min(ds) AS first_day FROM r GROUP BY 1, 2, 3""",
    "series_tail": f"""WITH {S.DAILY}, r AS (SELECT *, row_number() OVER (PARTITION BY crop, state ORDER BY ds DESC) AS back FROM daily)
 SELECT crop, state, count(*) AS tail_rows, string_agg(strftime(ds, '%Y-%m-%d') || '=' || y_cents, ',' ORDER BY ds) AS tail FROM r WHERE back <= 60 GROUP BY 1, 2""",
    "daily_change": f"WITH {S.DAILY} SELECT crop, state, ds, {S.rs('y_cents')} AS y, {S.rs('abs(y_cents - lag(y_cents) OVER (PARTITION BY crop, state ORDER BY ds))')} AS abs_change FROM daily",
    "calendar_dense": f"WITH {S.DAILY} SELECT crop, state, date_diff('day', min(ds), max(ds)) + 1 AS days, count(*) AS days_with_price FROM daily GROUP BY 1, 2",
}
