"""Price cleaning, roll-up, quality and current-price queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow import dims, schemas
from furrow.functions import numeric as N
from furrow.operators import clean, features, prices
from furrow.plans import sql as S
from furrow.session import cut_lineage, scratch_path
from furrow.sources import files, store
from furrow.sources import tables as T

GRID_CROPS = [t.lower() for t in T.TYPE_CROPS] + ["cotton"]
CHAIN_CROPS = ["wheat", "rice", "maize", "potato", "onion", "soybean", "cotton", "barley"]
FUTURES = [("wheat", 560.25), ("soybean", 1040.5), ("maize", 0.0)]
BATCH_CROPS = ["rice", "wheat"]
BATCH_SEEN = "2001-12-05"
BATCH_FROM, CACHE_FROM, RUN_TS = "2001-10-20", "2001-11-01", "2001-11-05 00:00:00"


def daily(spark, sf):
    return prices.daily_rollup(T.quotes(spark, sf))


def stored_daily(spark, sf):
    """The daily series written once, for queries that read it more than once.

    Its size is bounded by days x crops x states, so writing it is far cheaper
    than joining and rolling up all quotes again.
    """
    return cut_lineage(daily(spark, sf), "daily")


def history(spark, sf):
    """Stored series: days before the split, plus a few later days that overlap the increment."""
    d = daily(spark, sf)
    return d.where((F.col("ds") < F.lit(T.SPLIT_DATE).cast("date")) | (F.dayofmonth("ds") % 20 == 0))


def increment(spark, sf):
    return T.quotes(spark, sf).where(F.col("ds") >= F.lit(T.SPLIT_DATE).cast("date"))


def checked(spark, sf):
    return clean.check_quotes(T.raw_quotes(spark, sf), keep=["quote_id"])


def clean_quotes(spark, sf):
    return clean.accepted(checked(spark, sf)).select(
        "quote_id", "ds", "crop", "state", N.rupees(F.col("modal_cents")).alias("y"),
        N.rupees(F.col("min_cents")).alias("min_price"), N.rupees(F.col("max_cents")).alias("max_price"),
        N.rupees(F.col("range_cents")).alias("price_range"))


def reject_counts(spark, sf):
    return clean.reject_counts(checked(spark, sf))


def archive_rollup(spark, sf):
    rows = clean.accepted(clean.check_archive(T.raw_quotes(spark, sf)))
    return prices.in_rupees(prices.daily_rollup(rows))


def quote_files(spark, sf):
    """All raw quotes landed as JSON lines, read back and cleaned."""
    path = scratch_path(spark, "quotes-json")
    T.raw_quotes(spark, sf).write.json(path)
    rows = files.read_quote_json(spark, path)
    return clean.accepted(clean.check_quotes(rows, keep=["quote_id"])).select(
        F.col("quote_id").cast("bigint").alias("quote_id"), "ds", "crop", "state", N.rupees(F.col("modal_cents")).alias("y"))


def archive_files(spark, sf):
    """All raw quotes landed as yearly archive files, read back and rolled up."""
    folder, years = scratch_path(spark, "archive"), range(2019, 2025)
    raw = T.raw_quotes(spark, sf)
    columns = [F.col(c) if c in raw.columns else F.lit("").alias(c) for c in schemas.ARCHIVE_COLUMNS]
    for k, year in enumerate(years):
        part = raw.where(F.col("quote_id") % len(years) == k).select(*columns)
        part.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{folder}/{year}.csv")
    return prices.in_rupees(prices.daily_rollup(clean.accepted(clean.check_archive(files.read_archive(spark, folder, years)))))


def stored_series(spark, sf):
    """The daily series appended to a store in two parts and read back."""
    path = scratch_path(spark, "series")
    rows = prices.in_rupees(daily(spark, sf))
    early = F.col("ds") < F.lit(T.SPLIT_DATE).cast("date")
    for part in (rows.where(early), rows.where(~early)):
        files.append_series(part, path)
    return files.read_series(spark, path).select(*rows.columns)


def ingest_accounting(spark, sf):
    good = checked(spark, sf)
    known = clean.accepted(good).where(F.col("ds") < F.lit(T.SPLIT_DATE).cast("date")).select("ds", "crop", "state").distinct()
    return clean.ingest_accounting(good, known)


def daily_rollup(spark, sf):
    return prices.in_rupees(daily(spark, sf))


def append_new_keys(spark, sf):
    fresh = prices.new_rows(history(spark, sf), prices.daily_rollup(increment(spark, sf)))
    return prices.in_rupees(fresh)


def latest_batch_prices(spark, sf):
    """Mean price text of the latest day of each commodity and state, seen half a year later."""
    return clean.latest_plain_batch(T.raw_quotes(spark, sf), F.lit(BATCH_SEEN).cast("date"), ("commodity", "state"))


def monthly_store(spark, sf):
    """The stored series after its history, an increment and a replay of that increment."""
    table = scratch_path(spark, "months")
    store.write_months(history(spark, sf), table)
    store.merge_increment(increment(spark, sf), table)
    store.merge_increment(increment(spark, sf), table)
    return prices.in_rupees(store.read_months(spark, table))


def merged_series_std(spark, sf):
    """Deviation recomputed over history plus increment, not defaulted to zero."""
    merged = prices.merge_series(history(spark, sf), increment(spark, sf))
    w = merged.select("crop", "state", "ds", features.rolling_std(7).alias("rolling_std_7"))
    return w.where(F.col("ds") >= F.lit(T.SPLIT_DATE).cast("date"))


def _states(spark, sf):
    return T.table(spark, sf, "nation").select(F.col("n_name").alias("state"))


def coverage_grid(spark, sf):
    return prices.coverage_grid(daily(spark, sf), _states(spark, sf), GRID_CROPS)


def coverage_totals(spark, sf):
    return prices.coverage_totals(coverage_grid(spark, sf))


def coverage_by_series(spark, sf):
    return prices.coverage_by_series(daily(spark, sf))


def data_quality(spark, sf):
    return prices.data_quality(T.quotes(spark, sf), "modal_cents")


def missing_values(spark, sf):
    return prices.null_profile(T.raw_quotes(spark, sf), ["State", "Commodity", "Min_Price", "Max_Price", "Modal_Price"])


def extreme_values(spark, sf):
    return prices.extreme_values(daily(spark, sf), 180_000)


def latest_batch(spark, sf):
    return prices.latest_batch(T.quotes(spark, sf))


def monthly_seasonality(spark, sf):
    return prices.monthly_seasonality(daily(spark, sf))


def price_distribution(spark, sf):
    return prices.distribution(stored_daily(spark, sf))


def price_outliers(spark, sf):
    return prices.iqr_outliers(stored_daily(spark, sf))


def latest_price(spark, sf):
    return prices.latest_price(T.quotes(spark, sf), F.lit("2001-11-05").cast("date"))


def price_source_chain(spark, sf):
    good = clean.accepted(checked(spark, sf))
    keys = prices.grid(spark.createDataFrame([(s,) for s in dims.ALL_STATES], "state string"), CHAIN_CROPS)
    # Three sources derive from the recent days, so their sums are written once.
    days = cut_lineage(prices.day_sums(good.where(F.col("ds") >= F.lit(BATCH_FROM).cast("date"))), "days")
    # The batch service covers two staples; the cache holds what was seen in the last days.
    batch = prices.latest_of_days(days.where(F.col("crop").isin(BATCH_CROPS)))
    per = days.where(F.col("ds") >= F.lit(CACHE_FROM).cast("date"))
    own = per.groupBy("crop", "state").agg(F.max_by(F.struct("ds", "m"), "ds").alias("b"))
    every = per.groupBy("crop").agg(F.max(F.struct("ds", "m")).alias("b")).select("crop", F.lit("All").alias("state"), "b")
    cache = own.unionByName(every).select("crop", "state", N.rupees(F.col("b.m")).alias("price"),
                                          F.col("b.ds").cast("timestamp").alias("ts"))
    futures = spark.createDataFrame(FUTURES, "crop string, price double")
    return prices.price_source_chain(keys, batch, cache, futures, F.lit(RUN_TS).cast("timestamp"))


def current_price(spark, sf):
    q = T.quotes(spark, sf)
    latest = prices.latest_price(q, F.lit("2001-11-05").cast("date"), 3)
    return prices.current_price(latest, features.series_tail(prices.daily_rollup(q)))


def weekly_prices(spark, sf):
    return prices.weekly_mean(daily(spark, sf))


def weekly_to_daily(spark, sf):
    from pyspark.sql import Window as W
    weekly = prices.weekly_mean(daily(spark, sf))
    back = F.row_number().over(W.partitionBy("crop", "state").orderBy(F.col("week_end").desc())) - 1
    return prices.weeks_to_days(weekly.withColumn("step", back).where("step < 5"), 30)


QUERIES = {f.__name__: f for f in [
    quote_files, archive_files, stored_series, clean_quotes, reject_counts, archive_rollup, ingest_accounting, daily_rollup, append_new_keys, latest_batch_prices, monthly_store, merged_series_std,
    coverage_grid, coverage_totals, coverage_by_series, data_quality, missing_values, extreme_values, latest_batch,
    monthly_seasonality, price_distribution, price_outliers, latest_price, price_source_chain, current_price,
    weekly_prices, weekly_to_daily]}

# ------------------------------------------------------------------ check SQL
CHECKED = S.RAW_QUOTES + f""",
{S.STATE_MAP}, {S.CROP_MAP},
parsed AS (
 SELECT quote_id, m.crop, CASE WHEN trim(State) <> '' THEN coalesce(s.canonical, {S.initcap('trim(State)')}) END AS state,
  CAST(coalesce(try_strptime(Arrival_Date, '%d/%m/%Y'), try_strptime(Arrival_Date, '%Y-%m-%d'), try_strptime(Arrival_Date, '%d-%m-%Y')) AS DATE) AS ds,
  coalesce(nullif(try_cast(Modal_Price AS DOUBLE), 0), 0) AS modal,
  coalesce(nullif(try_cast(Min_Price AS DOUBLE), 0), nullif(try_cast(Modal_Price AS DOUBLE), 0), 0) AS a,
  coalesce(nullif(try_cast(Max_Price AS DOUBLE), 0), nullif(try_cast(Modal_Price AS DOUBLE), 0), 0) AS b
 FROM raw_quotes LEFT JOIN state_map s ON s.spelling = lower(trim(State)) LEFT JOIN crop_map m ON m.commodity = lower(trim(raw_quotes.Commodity))),
checked AS (
 SELECT *, {S.whole('modal * 100.0')} AS modal_cents, {S.whole('least(a, b, modal) * 100.0')} AS min_cents,
  {S.whole('greatest(a, b, modal) * 100.0')} AS max_cents,
  {S.whole('(greatest(a, b, modal) - least(a, b, modal)) * 100.0')} AS range_cents,
  CASE WHEN crop IS NULL THEN 'UNKNOWN_CROP' WHEN state IS NULL THEN 'MISSING_STATE' WHEN ds IS NULL THEN 'BAD_DATE'
   WHEN NOT (modal BETWEEN 100 AND 45000) THEN 'PRICE_OUT_OF_BOUNDS' END AS reject_reason FROM parsed)"""

SPLIT = f"DATE '{T.SPLIT_DATE}'"
HISTORY = S.DAILY + f""", history AS (SELECT * FROM daily WHERE ds < {SPLIT} OR day(ds) % 20 = 0),
fresh AS (SELECT d.* FROM daily d WHERE ds >= {SPLIT} AND NOT EXISTS
 (SELECT 1 FROM history h WHERE h.ds = d.ds AND h.crop = d.crop AND h.state = d.state))"""

RUPEES = (f"ds, crop, state, {S.rs('y_cents')} AS y, {S.rs('min_cents')} AS min_price, {S.rs('max_cents')} AS max_price, "
          f"market_count, {S.rs('range_cents')} AS price_range")

GRID = (f"grid AS (SELECT n_name AS state, c.crop FROM nation, (VALUES {', '.join('(' + S.lit(c) + ')' for c in GRID_CROPS)}) c(crop)),\n"
        """coverage AS (SELECT g.state, g.crop, coalesce(CAST(sum(market_count) AS BIGINT), 0) AS record_count,
  min(ds) AS first_date, max(ds) AS last_date FROM grid g LEFT JOIN daily d ON d.state = g.state AND d.crop = g.crop GROUP BY 1, 2),
graded AS (SELECT *, CASE WHEN record_count = 0 THEN 'NO_DATA' WHEN record_count < 50 THEN 'INSUFFICIENT'
  WHEN record_count < 200 THEN 'LIMITED' ELSE 'ADEQUATE' END AS coverage_status FROM coverage)""")

Q = "CAST({0} AS DOUBLE)"
CHAIN_KEYS = f"keys AS (SELECT s.state, c.crop FROM (VALUES {', '.join('(' + S.lit(s) + ')' for s in dims.ALL_STATES)}) s(state), (VALUES {', '.join('(' + S.lit(c) + ')' for c in CHAIN_CROPS)}) c(crop))"

ORACLES = {
    "quote_files": f"WITH {CHECKED} SELECT quote_id, ds, crop, state, {S.rs('modal_cents')} AS y FROM checked WHERE reject_reason IS NULL",
    "clean_quotes": f"""WITH {CHECKED} SELECT quote_id, ds, crop, state, {S.rs('modal_cents')} AS y, {S.rs('min_cents')} AS min_price,
 {S.rs('max_cents')} AS max_price, {S.rs('range_cents')} AS price_range FROM checked WHERE reject_reason IS NULL""",
    "reject_counts": f"WITH {CHECKED} SELECT coalesce(reject_reason, 'ACCEPTED') AS outcome, count(*) AS row_count FROM checked GROUP BY 1",
    "archive_rollup": f"""WITH {S.RAW_QUOTES}, {S.STATE_MAP},
 arch AS (SELECT CASE WHEN lower(Commodity) LIKE '%wheat%' THEN 'wheat' WHEN lower(Commodity) LIKE '%paddy(dhan)(common)%' THEN 'rice'
   WHEN lower(Commodity) LIKE '%maize%' THEN 'maize' WHEN lower(Commodity) LIKE '%potato%' THEN 'potato'
   WHEN lower(Commodity) LIKE '%onion%' THEN 'onion' END AS crop, coalesce(s.canonical, trim(State)) AS state,
  CAST(coalesce(try_strptime(Arrival_Date, '%Y-%m-%d'), try_strptime(Arrival_Date, '%d/%m/%Y'), try_strptime(Arrival_Date, '%m/%d/%Y'),
   try_strptime(Arrival_Date, '%d-%m-%Y')) AS DATE) AS ds, try_cast(Modal_Price AS DOUBLE) AS modal,
  {S.whole('coalesce(try_cast(Modal_Price AS DOUBLE), 0) * 100.0')} AS modal_cents,
  {S.whole('coalesce(try_cast(Min_Price AS DOUBLE), 0) * 100.0')} AS min_cents,
  {S.whole('coalesce(try_cast(Max_Price AS DOUBLE), 0) * 100.0')} AS max_cents
  FROM raw_quotes LEFT JOIN state_map s ON s.spelling = lower(trim(State))),
 good AS (SELECT * FROM arch WHERE crop IS NOT NULL AND modal > 0 AND ds IS NOT NULL AND state <> ''),
 {S.daily_from('good')} SELECT {RUPEES} FROM daily""",
    "ingest_accounting": f"""WITH {CHECKED}, good AS (SELECT * FROM checked WHERE reject_reason IS NULL),
 known AS (SELECT DISTINCT ds, crop, state FROM good WHERE ds < {SPLIT}),
 added AS (SELECT DISTINCT ds, crop, state FROM good WHERE (ds, crop, state) NOT IN (SELECT (ds, crop, state) FROM known))
 SELECT (SELECT count(*) FROM checked) AS raw, (SELECT count(*) FROM good) AS valid,
  (SELECT count(*) FROM checked WHERE reject_reason IS NOT NULL) AS rejected,
  (SELECT count(*) FROM good) - (SELECT count(*) FROM added) AS duplicate, (SELECT count(*) FROM added) AS added""",
    "daily_rollup": f"WITH {S.DAILY} SELECT {RUPEES} FROM daily",
    "append_new_keys": f"WITH {HISTORY} SELECT {RUPEES} FROM fresh",
    "latest_batch_prices": f"""WITH {S.RAW_QUOTES}, p AS (SELECT trim(Commodity) AS commodity, trim(State) AS state,
  CAST(coalesce(try_strptime(Arrival_Date, '%Y-%m-%d'), try_strptime(Arrival_Date, '%d/%m/%Y'), try_strptime(Arrival_Date, '%d-%m-%Y')) AS DATE) AS ds,
  CASE WHEN regexp_full_match(Modal_Price, '[0-9]+[.]?[0-9]*|[.][0-9]+') THEN {S.whole('CAST(Modal_Price AS DOUBLE) * 100.0')} END AS cents FROM raw_quotes),
 d AS (SELECT commodity, state, ds, CAST(sum(cents) AS BIGINT) AS s, count(cents) AS n, row_number() OVER (PARTITION BY commodity, state ORDER BY ds DESC) AS rn FROM p GROUP BY 1, 2, 3),
 a AS (SELECT *, greatest(date_diff('day', ds, DATE '{BATCH_SEEN}'), 0) AS data_age_days FROM d WHERE rn = 1 AND n > 0)
 SELECT commodity, state, ds, n AS prices, {S.rnd('CAST(s AS DOUBLE) / n / 100.0', 2)} AS avg_price, data_age_days,
  CASE WHEN data_age_days <= 3 THEN 'VERY_FRESH' WHEN data_age_days <= 14 THEN 'FRESH' WHEN data_age_days <= 30 THEN 'RECENT' WHEN data_age_days <= 60 THEN 'BACKGROUND'
   WHEN data_age_days <= 180 THEN 'STALE' ELSE 'VERY_STALE' END AS freshness_label FROM a""",
    "monthly_store": f"WITH {HISTORY} SELECT {RUPEES} FROM history UNION ALL SELECT {RUPEES} FROM fresh",
    "merged_series_std": f"""WITH {HISTORY}, merged AS (SELECT * FROM history UNION ALL SELECT * FROM fresh),
 w AS (SELECT crop, state, ds, CAST(count(y_cents) OVER f AS DOUBLE) AS n, CAST(sum(y_cents) OVER f AS DOUBLE) AS s,
  CAST(sum(y_cents * y_cents) OVER f AS DOUBLE) AS q FROM merged
  WINDOW f AS (PARTITION BY crop, state ORDER BY ds ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))
 SELECT crop, state, ds, CASE WHEN n > 1 THEN sqrt(greatest(n * q - s * s, 0) / (n * (n - 1))) / 100.0 ELSE 0.0 END AS rolling_std_7
 FROM w WHERE ds >= {SPLIT}""",
    "coverage_grid": f"WITH {S.DAILY}, {GRID} SELECT * FROM graded",
    "coverage_totals": f"""WITH {S.DAILY}, {GRID} SELECT count(DISTINCT CASE WHEN record_count > 0 THEN state END) AS unique_states,
 count(*) FILTER (coverage_status = 'ADEQUATE') AS adequate_pairs, count(*) FILTER (coverage_status = 'LIMITED') AS limited_pairs,
 count(*) FILTER (coverage_status = 'INSUFFICIENT') AS insufficient_pairs, count(*) FILTER (coverage_status = 'NO_DATA') AS no_data_pairs FROM graded""",
    "coverage_by_series": f"""WITH {S.DAILY} SELECT crop, state, count(*) AS record_count,
 strftime(min(ds), '%Y-%m-%d') || ' to ' || strftime(max(ds), '%Y-%m-%d') AS date_range,
 {S.rnd('CAST(CAST(sum(y_cents) AS BIGINT) AS DOUBLE) / count(*) / 100.0', 2)} AS avg_price,
 CASE WHEN count(*) >= 60 THEN 'SUFFICIENT' ELSE 'LIMITED' END AS status FROM daily GROUP BY 1, 2""",
    "data_quality": f"""WITH {S.QUOTES}, t AS (SELECT count(*) AS total_records, count(*) - (SELECT count(*) FROM (SELECT DISTINCT ds, crop, state FROM quotes)) AS duplicate_records,
 count(*) FILTER (modal_cents <= 0) AS non_positive_prices, strftime(min(ds), '%Y-%m-%d') || ' to ' || strftime(max(ds), '%Y-%m-%d') AS date_span FROM quotes)
 SELECT *, CASE WHEN duplicate_records = 0 AND non_positive_prices = 0 THEN 'PASS' ELSE 'WARNING' END AS data_quality_status FROM t""",
    "missing_values": f"WITH {S.RAW_QUOTES} " + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER (coalesce(trim({c}), '') = '') AS missing FROM raw_quotes"
        for c in ["State", "Commodity", "Min_Price", "Max_Price", "Modal_Price"]),
    "extreme_values": f"WITH {S.DAILY} SELECT crop, count(*) FILTER (y_cents > 180000) AS extreme_values FROM daily GROUP BY 1",
    "latest_batch": f"""WITH {S.QUOTES}, r AS (SELECT *, rank() OVER (PARTITION BY crop, state ORDER BY ds DESC) AS rk FROM quotes)
 SELECT crop, state, ds AS arrival_date, count(*) AS quotes, {S.rnd('CAST(CAST(sum(modal_cents) AS BIGINT) AS DOUBLE) / count(*) / 100.0', 2)} AS price
 FROM r WHERE rk = 1 GROUP BY 1, 2, 3""",
    "monthly_seasonality": f"""WITH {S.DAILY} SELECT crop, month(ds) AS month, CAST(CAST(sum(y_cents) AS BIGINT) AS DOUBLE) / count(*) / 100.0 AS avg_price
 FROM daily GROUP BY 1, 2""",
    "price_distribution": f"""WITH {S.DAILY} SELECT crop, count(*) AS row_count, {S.rnd('CAST(CAST(sum(y_cents) AS BIGINT) AS DOUBLE) / count(*) / 100.0', 4)} AS mean_price,
 {S.rnd('stddev_samp(y_cents) / 100.0', 4)} AS std_price, {S.rs('min(y_cents)')} AS min_price,
 {S.rnd('quantile_cont(CAST(y_cents AS DOUBLE), 0.25) / 100.0', 4)} AS p25, {S.rnd('quantile_cont(CAST(y_cents AS DOUBLE), 0.5) / 100.0', 4)} AS p50,
 {S.rnd('quantile_cont(CAST(y_cents AS DOUBLE), 0.75) / 100.0', 4)} AS p75, {S.rs('max(y_cents)')} AS max_price FROM daily GROUP BY 1""",
    "price_outliers": f"""WITH {S.DAILY}, q AS (SELECT crop, quantile_cont(CAST(y_cents AS DOUBLE), 0.25) AS a, quantile_cont(CAST(y_cents AS DOUBLE), 0.75) AS b FROM daily GROUP BY 1),
 t AS (SELECT d.crop, count(*) FILTER (y_cents < a - 1.5 * (b - a) OR y_cents > b + 1.5 * (b - a)) AS outliers, count(*) AS n FROM daily d JOIN q USING (crop) GROUP BY 1)
 SELECT crop, outliers, {S.rnd('outliers * CAST(100.0 AS DOUBLE) / n', 2)} AS outlier_pct FROM t""",
    "latest_price": f"""WITH {S.QUOTES}, r AS (SELECT *, row_number() OVER (PARTITION BY crop, state ORDER BY ds DESC, market DESC, modal_cents DESC) AS rn FROM quotes)
 SELECT crop, state, {S.rs('modal_cents')} AS price, market, ds AS arrival_date, greatest(date_diff('day', ds, DATE '2001-11-05'), 0) AS data_age_days,
  CASE WHEN date_diff('day', ds, DATE '2001-11-05') <= 3 THEN 'Fresh' WHEN date_diff('day', ds, DATE '2001-11-05') <= 7 THEN 'Recent' ELSE 'Historical' END AS freshness_label,
  date_diff('day', ds, DATE '2001-11-05') >= 3 AS stale FROM r WHERE rn = 1""",
    "price_source_chain": f"""WITH {CHECKED}, {CHAIN_KEYS},
 recent AS (SELECT * FROM checked WHERE reject_reason IS NULL AND ds >= DATE '{BATCH_FROM}'),
 br AS (SELECT *, rank() OVER (PARTITION BY crop, state ORDER BY ds DESC) AS rk FROM recent WHERE crop IN ('rice', 'wheat')),
 batch AS (SELECT crop, state, {S.rnd('CAST(CAST(sum(modal_cents) AS BIGINT) AS DOUBLE) / count(*) / 100.0', 2)} AS price FROM br WHERE rk = 1 GROUP BY 1, 2),
 st AS (SELECT * FROM recent WHERE ds >= DATE '{CACHE_FROM}'),
 own AS (SELECT crop, state, {S.rs('modal_cents')} AS price, date_diff('hour', CAST(ds AS TIMESTAMP), TIMESTAMP '{RUN_TS}') AS h
  FROM (SELECT *, row_number() OVER (PARTITION BY crop, state ORDER BY ds DESC, modal_cents DESC) AS rn FROM st) WHERE rn = 1),
 every AS (SELECT crop, {S.rs('modal_cents')} AS price, date_diff('hour', CAST(ds AS TIMESTAMP), TIMESTAMP '{RUN_TS}') AS h
  FROM (SELECT *, row_number() OVER (PARTITION BY crop ORDER BY ds DESC, modal_cents DESC) AS rn FROM st) WHERE rn = 1),
 {S.values('futures', 'crop, price', FUTURES)}, {S.values('units', 'crop, unit, kg', [(c, u, k) for c, (u, k) in dims.FUTURES_UNITS.items()])},
 {S.values('ff', 'state, f', dims.FUTURES_STATE_FACTORS.items())}, {S.values('sf', 'state, f', dims.SUPPORT_STATE_FACTORS.items())},
 {S.values('sp', 'crop, base', dims.SUPPORT_PRICES.items())},
 j AS (SELECT k.crop, k.state, b.price AS bp, coalesce(o.price, e.price) AS cp, CAST(coalesce(o.h, e.h) AS DOUBLE) AS ch,
  CASE WHEN u.unit = 'cents_bushel' THEN (fu.price / 100.0) / u.kg ELSE fu.price / (u.kg * 100.0) END AS fp, fu.price AS fraw,
  coalesce(ff.f, 1.0) AS f1, coalesce(sf.f, 1.0) AS f2, CAST(coalesce(sp.base, 2200) AS DOUBLE) AS base
  FROM keys k LEFT JOIN batch b ON b.crop = k.crop AND b.state = k.state
  LEFT JOIN (SELECT * FROM own WHERE h < 72) o ON o.crop = k.crop AND o.state = k.state LEFT JOIN (SELECT * FROM every WHERE h < 72) e ON e.crop = k.crop
  LEFT JOIN futures fu ON fu.crop = k.crop LEFT JOIN units u ON u.crop = k.crop
  LEFT JOIN ff ON ff.state = lower(k.state) LEFT JOIN sf ON sf.state = lower(k.state) LEFT JOIN sp ON sp.crop = k.crop)
 SELECT crop, state, CASE WHEN bp IS NOT NULL THEN bp WHEN cp IS NOT NULL THEN cp
   WHEN fraw > 0 THEN {S.rnd(S.rnd('fp * CAST(100.0 AS DOUBLE) * CAST(83.5 AS DOUBLE)', 2) + ' * CAST(f1 AS DOUBLE)', 2)}
   ELSE {S.rnd('greatest(CAST(500 AS DOUBLE), base * CAST(f2 AS DOUBLE))', 2)} END AS current_price,
  CASE WHEN bp IS NOT NULL THEN 'api_batch' WHEN cp IS NOT NULL THEN 'cached_api' WHEN fraw > 0 THEN 'futures' ELSE 'support_price' END AS data_source,
  CASE WHEN bp IS NOT NULL THEN 'fresh' WHEN cp IS NOT NULL THEN CASE WHEN ch < 24 THEN 'fresh' WHEN ch < 72 THEN 'stale' ELSE 'old' END
   WHEN fraw > 0 THEN 'fresh' ELSE 'estimated' END AS data_quality,
  CASE WHEN bp IS NOT NULL THEN CAST(0 AS DOUBLE) WHEN cp IS NOT NULL THEN ch WHEN fraw > 0 THEN CAST(0 AS DOUBLE) END AS data_age_hours FROM j""",
    "current_price": f"""WITH {S.DAILY}, l AS (SELECT *, row_number() OVER (PARTITION BY crop, state ORDER BY ds DESC, market DESC, modal_cents DESC) AS rn FROM quotes),
 t AS (SELECT *, row_number() OVER (PARTITION BY crop, state ORDER BY ds DESC) AS rn FROM daily),
 j AS (SELECT t.crop, t.state, t.y_cents, t.ds AS tds, l.modal_cents, l.ds AS lds, date_diff('day', l.ds, DATE '2001-11-05') AS age
  FROM t LEFT JOIN l ON l.crop = t.crop AND l.state = t.state AND l.rn = 1 WHERE t.rn = 1)
 SELECT crop, state, CASE WHEN age < 3 THEN {S.rs('modal_cents')} ELSE {S.rs('y_cents')} END AS current_price,
  CASE WHEN age < 3 THEN lds ELSE tds END AS price_date, CASE WHEN age < 3 THEN greatest(age, 0) ELSE 7 END AS data_age_days,
  CASE WHEN age < 3 THEN 'FRESH' ELSE 'FALLBACK' END AS market_data_status FROM j""",
    "weekly_prices": f"""WITH {S.DAILY} SELECT crop, state, CAST(date_trunc('week', ds) AS DATE) + 6 AS week_end,
 CAST(CAST(sum(y_cents) AS BIGINT) AS DOUBLE) / count(*) / 100.0 AS y FROM daily GROUP BY 1, 2, 3""",
    "weekly_to_daily": f"""WITH {S.DAILY}, w AS (SELECT crop, state, CAST(date_trunc('week', ds) AS DATE) + 6 AS week_end,
 CAST(CAST(sum(y_cents) AS BIGINT) AS DOUBLE) / count(*) / 100.0 AS y FROM daily GROUP BY 1, 2, 3),
 r AS (SELECT *, row_number() OVER (PARTITION BY crop, state ORDER BY week_end DESC) - 1 AS step FROM w)
 SELECT crop, state, step * 7 + d.d AS day, y FROM r, (SELECT unnest(range(7)) AS d) d WHERE step < 5 AND step * 7 + d.d < 30""",
}
# What is landed and read back is what was there.
ORACLES |= {"archive_files": ORACLES["archive_rollup"], "stored_series": ORACLES["daily_rollup"]}
