"""Leakage-safe features of daily price series.

All windows share one partitioning and order, so Spark plans a single exchange
and sort.  A partition is one series of daily rows: its length is bounded by the
number of calendar days, however many quotes were rolled up into it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from furrow import dims
from furrow.functions import dates as D
from furrow.functions import numeric as N
from furrow.functions import text as X

SERIES = ["crop", "state"]
LAGS = (1, 7, 14, 30)


def series_window(order: str = "ds") -> W:
    return W.partitionBy(*SERIES).orderBy(order)


def prior(k: int) -> W:
    """The k rows before the current one."""
    return series_window().rowsBetween(-k, -1)


def rolling_mean(k: int, frame=None) -> Column:
    w = frame if frame is not None else prior(k)
    return F.sum("y_cents").over(w).cast("double") / F.count("y_cents").over(w) / F.lit(100.0)


def rolling_std(k: int) -> Column:
    """Sample deviation of the k prior rows; zero when fewer than two."""
    y = F.col("y_cents").cast("double")
    n = F.count("y_cents").over(prior(k)).cast("double")
    sd = N.sample_std(n, F.sum(y).over(prior(k)), F.sum(y * y).over(prior(k)))
    return F.coalesce(sd / F.lit(100.0), F.lit(0.0))


def price_range(columns: Sequence[str]) -> Column:
    """Range column if present, else max minus min floored at zero, else zero."""
    if "range_cents" in columns:
        return N.rupees(F.coalesce("range_cents", F.lit(0).cast("bigint")))
    if {"min_cents", "max_cents"} <= set(columns):
        return N.rupees(F.greatest(F.col("max_cents") - F.col("min_cents"), F.lit(0).cast("bigint")))
    return F.lit(0.0)


def lag_features(daily: DataFrame, disruptions: Sequence[tuple[str, str]], min_rows: int = 15,
                 need_lags: bool = True) -> DataFrame:
    """The 14 model features (state code included) of each series with enough rows."""
    w = series_window()
    cols = [F.lag("y_cents", k).over(w).alias(f"lag_{k}_cents") for k in LAGS]
    wide = daily.select(
        "*", *cols, rolling_mean(7).alias("rolling_7"), rolling_mean(30).alias("rolling_30"),
        rolling_std(7).alias("rolling_std_7"), F.count(F.lit(1)).over(W.partitionBy(*SERIES)).alias("series_rows"))
    kept = wide.where(F.col("series_rows") >= min_rows)
    if need_lags:
        kept = kept.where(" AND ".join(f"lag_{k}_cents IS NOT NULL" for k in LAGS))
    return kept.select(
        *SERIES, "ds", N.rupees(F.col("y_cents")).alias("y"),
        *[N.rupees(F.col(f"lag_{k}_cents")).alias(f"lag_{k}") for k in LAGS],
        "rolling_7", "rolling_30", "rolling_std_7", price_range(daily.columns).alias("price_range"),
        F.dayofyear("ds").cast("bigint").alias("day_of_year"), F.month("ds").cast("bigint").alias("month"),
        F.weekday("ds").cast("bigint").alias("day_of_week"), F.year("ds").cast("bigint").alias("year"),
        F.when(D.in_any(F.col("ds"), disruptions), F.lit(1)).otherwise(F.lit(0)).cast("bigint").alias("black_swan"))


def state_codes(daily: DataFrame, min_rows: int = 15, longest_lag: int = max(LAGS)) -> DataFrame:
    """Alphabetical code of each state within its crop, from zero.

    A series has feature rows exactly when it is longer than the longest lag, so
    row counts of the daily series are enough; no feature is computed for this.
    """
    counts = daily.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("n"))
    pairs = counts.where(F.col("n") >= max(min_rows, longest_lag + 1))
    code = F.row_number().over(W.partitionBy("crop").orderBy("state")) - 1
    return pairs.select(*SERIES, code.cast("bigint").alias("state_enc"))


def encoded_features(daily: DataFrame, disruptions: Sequence[tuple[str, str]], min_rows: int = 15) -> DataFrame:
    """Lag features with the state code; give it a stored daily series, which is read twice."""
    return lag_features(daily, disruptions, min_rows).join(state_codes(daily, min_rows), SERIES)


def leakage_check(features: DataFrame) -> DataFrame:
    """Mean absolute difference of lag 1 and target; zero means the target leaked."""
    diff = F.abs(N.cents(F.col("lag_1")) - N.cents(F.col("y")))
    one = features.agg(F.sum(diff).alias("s"), F.count(F.lit(1)).alias("n"))
    mean = F.col("s").cast("double") / F.col("n") / F.lit(100.0)
    return one.select(F.col("n").alias("rows_checked"), mean.alias("mean_abs_diff"),
                      F.when(mean == 0.0, "FAILED").otherwise("SAFE_NO_LEAKAGE").alias("leakage_status"))


def cascade_features(daily: DataFrame, climate: DataFrame, disruptions: Sequence[tuple[str, str]],
                     start_offset: int = 30, include_current: bool = False) -> DataFrame:
    """The older 11 features: missing lags fall back to the next shorter one.

    Means use prior rows only; ``include_current`` restores the leaky variant for
    comparison and should stay off for training.
    """
    w = series_window()
    y = F.col("y_cents")
    raw = {k: F.lag("y_cents", k).over(w) for k in LAGS}
    lag_1 = F.coalesce(raw[1], y)
    lag_7 = F.coalesce(raw[7], lag_1)
    lag_14 = F.coalesce(raw[14], lag_7)
    lag_30 = F.coalesce(raw[30], lag_14)

    def mean(k: int) -> Column:
        if include_current:
            return rolling_mean(k, w.rowsBetween(-(k - 1), 0))
        return F.coalesce(rolling_mean(k), N.rupees(y))

    base = daily.select(
        *SERIES, "ds", N.rupees(y).alias("y"), F.row_number().over(w).alias("rn"),
        N.rupees(lag_1).alias("lag_1"), N.rupees(lag_7).alias("lag_7"), N.rupees(lag_14).alias("lag_14"),
        N.rupees(lag_30).alias("lag_30"), N.round_to(mean(7), 2).alias("rolling_mean_7"),
        N.round_to(mean(30), 2).alias("rolling_mean_30"), F.month("ds").cast("bigint").alias("month"),
        F.year("ds").cast("bigint").alias("year"))
    kept = base.where(F.col("rn") > start_offset)
    season = X.season_of_month(F.col("month"))
    code = F.create_map(*[F.lit(x) for kv in dims.SEASON_CODES.items() for x in kv])[season]
    return climate_lookup(kept, climate).select(
        *SERIES, "ds", "y", "lag_1", "lag_7", "lag_14", "lag_30", "rolling_mean_7", "rolling_mean_30", "month",
        code.cast("bigint").alias("season"), N.round_to(F.col("avg_temp"), 2).alias("monthly_avg_temp"),
        N.round_to(F.col("total_rainfall"), 2).alias("monthly_total_rainfall"),
        F.when(D.in_any(F.col("ds"), disruptions), F.lit(1)).otherwise(F.lit(0)).cast("bigint").alias("black_swan"))


def climate_levels(climate: DataFrame) -> DataFrame:
    """One row per calendar month: that month's mean over years, and the overall mean.

    Sums are taken over values scaled to whole millionths to stay exact.
    """
    def micro(c: str) -> Column:
        return F.floor(F.col(c) * F.lit(1000000.0) + F.lit(0.5)).cast("bigint")

    per = climate.groupBy("month").agg(
        F.sum(micro("avg_temp")).alias("t"), F.sum(micro("total_rainfall")).alias("r"), F.count(F.lit(1)).alias("n"))
    return per.select("month", "t", "r", "n")


def climate_lookup(rows: DataFrame, climate: DataFrame) -> DataFrame:
    """Climate of (year, month), else that month's mean, else the overall mean.

    The two fallback levels are folded into one table of twelve months, so the
    rows meet two equi joins and no chain of lookups.  Both tables have at most
    one row per calendar month, a bound set by the calendar and not by the data,
    so they are broadcast and the rows stay where they are.
    """
    levels = climate_levels(climate)
    scale = F.lit(1000000.0)
    monthly = levels.select("month", (F.col("t").cast("double") / F.col("n") / scale).alias("m_temp"),
                            (F.col("r").cast("double") / F.col("n") / scale).alias("m_rain"))
    overall = levels.agg((F.sum("t").cast("double") / F.sum("n") / scale).alias("g_temp"),
                         (F.sum("r").cast("double") / F.sum("n") / scale).alias("g_rain"))
    exact = climate.groupBy("year", "month").agg(F.first("avg_temp").alias("e_temp"), F.first("total_rainfall").alias("e_rain"))
    months = (rows.sparkSession.range(1, 13).select(F.col("id").alias("month"), F.lit(1).alias("one"))
              .join(monthly, "month", "left").join(overall.withColumn("one", F.lit(1)), "one")
              .select("month", F.coalesce("m_temp", "g_temp").alias("m_temp"), F.coalesce("m_rain", "g_rain").alias("m_rain")))
    return (rows.join(F.broadcast(exact), ["year", "month"], "left").join(F.broadcast(months), "month", "left")
            .withColumn("avg_temp", F.coalesce("e_temp", "m_temp"))
            .withColumn("total_rainfall", F.coalesce("e_rain", "m_rain"))
            .withColumn("climate_level", F.when(F.col("e_temp").isNotNull(), "YEAR_MONTH").otherwise("MONTH"))
            .drop("e_temp", "e_rain", "m_temp", "m_rain"))


def first_event(rows: DataFrame, events: Sequence[tuple[str, str, str, float]], day: str = "ds") -> DataFrame:
    """Label and factor of the first listed event whose closed interval holds the day.

    The list is fixed and short, so it becomes ordered predicates and no join.
    """
    label, factor = F.lit(None).cast("string"), F.lit(None).cast("double")
    for name, start, end, f in reversed(list(events)):
        hit = F.col(day).between(F.lit(start).cast("date"), F.lit(end).cast("date"))
        label, factor = F.when(hit, F.lit(name)).otherwise(label), F.when(hit, F.lit(float(f))).otherwise(factor)
    return rows.withColumn("event_label", label).withColumn("event_factor", factor)


def strict_rolling(daily: DataFrame, windows: Sequence[int] = (7, 30), lags: Sequence[int] = LAGS) -> DataFrame:
    """Lags and means that need a full window of prior rows; incomplete rows are dropped."""
    w = series_window()
    cols = {f"lag_{k}": N.rupees(F.lag("y_cents", k).over(w)) for k in lags}
    cols.update({f"rolling_mean_{k}": F.when(F.count("y_cents").over(prior(k)) == k, rolling_mean(k)) for k in windows})
    wide = daily.select(*SERIES, "ds", N.rupees(F.col("y_cents")).alias("y"), *[c.alias(n) for n, c in cols.items()])
    return wide.dropna(subset=list(cols))


def chronological_split(rows: DataFrame, cut: str, fallback: float = 0.8) -> DataFrame:
    """Adds ``part``: train before the cut date, test from it on.

    A crop without test rows is split by position instead; position is taken over
    day counts, so no crop is sorted in one task.
    """
    cut_day = F.lit(cut).cast("date")
    per_day = rows.groupBy("crop", "ds").agg(F.count(F.lit(1)).alias("c"))
    by_crop = W.partitionBy("crop")
    upto = by_crop.orderBy("ds").rowsBetween(W.unboundedPreceding, 0)
    marked = per_day.select(
        "crop", "ds", F.max((F.col("ds") >= cut_day)).over(by_crop).alias("has_test"),
        F.sum("c").over(upto).alias("upto"), F.sum("c").over(by_crop).alias("n"))
    late = F.when(F.col("has_test"), F.col("ds") >= cut_day).otherwise(
        F.col("upto") > F.floor(F.col("n") * F.lit(float(fallback))))
    # One row per crop and calendar day.
    parts = marked.select("crop", "ds", F.when(late, "test").otherwise("train").alias("part"))
    return rows.join(parts, ["crop", "ds"])


def last_rows_split(rows: DataFrame, holdout: int = 60) -> DataFrame:
    """Adds ``part``: the last ``holdout`` rows of each series are the test rows."""
    back = F.row_number().over(W.partitionBy(*SERIES).orderBy(F.col("ds").desc()))
    return rows.withColumn("part", F.when(back <= holdout, "test").otherwise("train"))


def series_tail(daily: DataFrame, k: int = 60) -> DataFrame:
    """The last k rows of each series as one ordered array.

    The row-number filter lets Spark limit each series before the shuffle; the
    array is bounded by k.
    """
    back = F.row_number().over(W.partitionBy(*SERIES).orderBy(F.col("ds").desc()))
    last = daily.withColumn("back", back).where(F.col("back") <= k)
    entry = F.struct("ds", "y_cents", "min_cents", "max_cents", "range_cents")
    return last.groupBy(*SERIES).agg(F.array_sort(F.collect_list(entry)).alias("tail"))


def daily_change(daily: DataFrame) -> DataFrame:
    before = F.lag("y_cents").over(series_window())
    return daily.select(*SERIES, "ds", N.rupees(F.col("y_cents")).alias("y"),
                        N.rupees(F.abs(F.col("y_cents") - before)).alias("abs_change"))


def calendar_dense(daily: DataFrame) -> DataFrame:
    """Every calendar day between the first and last day of a series; gaps have no price."""
    spans = daily.groupBy(*SERIES).agg(F.min("ds").alias("lo"), F.max("ds").alias("hi"))
    days = spans.select(*SERIES, F.explode(F.sequence("lo", "hi")).alias("ds"))
    return days.join(daily, SERIES + ["ds"], "left")
