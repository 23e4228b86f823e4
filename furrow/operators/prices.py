"""Daily price series: roll-up, incremental merge, coverage, quality and profiles.

Prices travel as whole cents, so every sum is exact whatever the order in which
partitions are combined; rupee columns are derived at the end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from furrow import dims
from furrow.functions import dates as D
from furrow.functions import numeric as N
from furrow.session import cut_lineage

SERIES = ["crop", "state"]
KEYS = ["ds", "crop", "state"]
STORE_COLUMNS = ["ds", "crop", "state", "y", "min_price", "max_price", "market_count", "price_range", "rolling_std_7"]


def daily_rollup(quotes: DataFrame) -> DataFrame:
    """One row per (ds, crop, state): mean modal, mean positive bounds, count, range.

    A single hash aggregation with map-side partial sums, so a key that holds a
    large share of all quotes still reaches the reducer as one row per task.
    """
    def positive(c: str) -> Column:
        return F.when(F.col(c) > 0, F.col(c))

    sums = quotes.groupBy(*KEYS).agg(
        F.sum("modal_cents").alias("s"), F.count(F.lit(1)).alias("market_count"),
        F.sum(positive("min_cents")).alias("smin"), F.count(positive("min_cents")).alias("nmin"),
        F.sum(positive("max_cents")).alias("smax"), F.count(positive("max_cents")).alias("nmax"))

    def mean(s: str, n: str) -> Column:
        return F.when(F.col(n) > 0, N.whole(F.col(s).cast("double") / F.col(n))).otherwise(F.lit(0).cast("bigint"))

    low, high = mean("smin", "nmin"), mean("smax", "nmax")
    both = (F.col("nmin") > 0) & (F.col("nmax") > 0)
    return sums.select(
        *KEYS, N.whole(F.col("s").cast("double") / F.col("market_count")).alias("y_cents"),
        low.alias("min_cents"), high.alias("max_cents"), "market_count",
        F.when(both, high - low).otherwise(F.lit(0).cast("bigint")).alias("range_cents"))


def in_rupees(daily: DataFrame, *extra: str) -> DataFrame:
    return daily.select(
        *KEYS, N.rupees(F.col("y_cents")).alias("y"), N.rupees(F.col("min_cents")).alias("min_price"),
        N.rupees(F.col("max_cents")).alias("max_price"), "market_count",
        N.rupees(F.col("range_cents")).alias("price_range"), *extra)


def new_rows(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows of ``incoming`` (one per key) whose key is not in ``existing``."""
    return incoming.join(existing.select(*KEYS), KEYS, "left_anti")


def merge_series(existing: DataFrame, incoming_quotes: DataFrame) -> DataFrame:
    """History plus unseen keys: the increment is averaged first, then appended."""
    return existing.unionByName(new_rows(existing, daily_rollup(incoming_quotes)), allowMissingColumns=True)


def grid(states: DataFrame, crops: Sequence[str], state: str = "state") -> DataFrame:
    """Every state with every crop of a fixed list, without a cross join."""
    return states.select(F.col(state).alias("state"), F.explode(F.array(*[F.lit(c) for c in crops])).alias("crop"))


def coverage_grid(daily: DataFrame, states: DataFrame, crops: Sequence[str]) -> DataFrame:
    """Quotes, first and last day and class of each (state, crop), zero-filled."""
    have = daily.groupBy("state", "crop").agg(
        F.sum("market_count").alias("n"), F.min("ds").alias("first_date"), F.max("ds").alias("last_date"))
    n = F.coalesce("n", F.lit(0).cast("bigint"))
    cls = (F.when(n == 0, "NO_DATA").when(n < 50, "INSUFFICIENT").when(n < 200, "LIMITED").otherwise("ADEQUATE"))
    return grid(states, crops).join(have, ["state", "crop"], "left").select(
        "state", "crop", n.alias("record_count"), "first_date", "last_date", cls.alias("coverage_status"))


def coverage_totals(coverage: DataFrame) -> DataFrame:
    """Pairs per class and states with any data, one row."""
    per_state = coverage.groupBy("state").agg(
        F.max(F.col("record_count") > 0).alias("has_data"),
        *[F.count_if(F.col("coverage_status") == c).alias(c) for c in
          ("ADEQUATE", "LIMITED", "INSUFFICIENT", "NO_DATA")])
    return per_state.agg(
        F.count_if("has_data").alias("unique_states"),
        *[F.sum(c).alias(f"{c.lower()}_pairs") for c in ("ADEQUATE", "LIMITED", "INSUFFICIENT", "NO_DATA")])


def coverage_by_series(daily: DataFrame, enough: int = 60) -> DataFrame:
    per = daily.groupBy("crop", "state").agg(
        F.count(F.lit(1)).alias("record_count"), F.min("ds").alias("lo"), F.max("ds").alias("hi"),
        F.sum("y_cents").alias("s"))
    return per.select(
        "crop", "state", "record_count",
        F.concat(F.date_format("lo", "yyyy-MM-dd"), F.lit(" to "), F.date_format("hi", "yyyy-MM-dd")).alias("date_range"),
        N.round_to(F.col("s").cast("double") / F.col("record_count") / F.lit(100.0), 2).alias("avg_price"),
        F.when(F.col("record_count") >= enough, "SUFFICIENT").otherwise("LIMITED").alias("status"))


def data_quality(rows: DataFrame, price: str = "y_cents") -> DataFrame:
    """Total rows, duplicate keys, non-positive prices, span and verdict.

    Counting per key first keeps the distinct count a plain aggregation.
    """
    per_key = rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(price) <= 0).alias("bad"))
    total = per_key.agg(
        F.sum("n").alias("total_records"), F.sum(F.col("n") - 1).alias("duplicate_records"),
        F.sum("bad").alias("non_positive_prices"), F.min("ds").alias("lo"), F.max("ds").alias("hi"))
    ok = (F.col("duplicate_records") == 0) & (F.col("non_positive_prices") == 0)
    return total.select(
        "total_records", "duplicate_records", "non_positive_prices",
        F.concat(F.date_format("lo", "yyyy-MM-dd"), F.lit(" to "), F.date_format("hi", "yyyy-MM-dd")).alias("date_span"),
        F.when(ok, "PASS").otherwise("WARNING").alias("data_quality_status"))


def null_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing (null or blank) values per column in one pass."""
    one = df.agg(*[F.count_if(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "").alias(c) for c in columns])
    return one.unpivot([], list(columns), "column_name", "missing")


def extreme_values(daily: DataFrame, above_cents: int) -> DataFrame:
    """Rows per crop above a price limit."""
    return daily.groupBy("crop").agg(F.count_if(F.col("y_cents") > above_cents).alias("extreme_values"))


def day_sums(quotes: DataFrame) -> DataFrame:
    """Sum, count and highest modal price per series and day: a busy key shrinks to one row per day and task."""
    return quotes.groupBy(*SERIES, "ds").agg(
        F.sum("modal_cents").alias("s"), F.count(F.lit(1)).alias("n"), F.max("modal_cents").alias("m"))


def latest_batch(quotes: DataFrame) -> DataFrame:
    """Mean modal price of the most recent arrival date of each series."""
    return latest_of_days(day_sums(quotes))


def latest_of_days(per_day: DataFrame) -> DataFrame:
    last = per_day.groupBy(*SERIES).agg(F.max_by(F.struct("ds", "s", "n"), "ds").alias("b"))
    return last.select(*SERIES, F.col("b.ds").alias("arrival_date"), F.col("b.n").alias("quotes"),
                       N.round_to(F.col("b.s").cast("double") / F.col("b.n") / F.lit(100.0), 2).alias("price"))


def monthly_seasonality(daily: DataFrame) -> DataFrame:
    per = daily.groupBy("crop", F.month("ds").cast("bigint").alias("month")).agg(
        F.sum("y_cents").alias("s"), F.count(F.lit(1)).alias("n"))
    return per.select("crop", "month", (F.col("s").cast("double") / F.col("n") / F.lit(100.0)).alias("avg_price"))


#: Neighbouring values that are counted together to find where a quantile lies.
QUANTILE_BIN = 1024


def exact_quantiles(df: DataFrame, group: str, value: str, probs: Sequence[float]) -> DataFrame:
    """Exact linear-interpolated quantiles per group of whole numbers, as ``q<percent>`` columns.

    Values are counted, and the counts added up per bin of neighbouring values.  Only these bin totals are
    put in order, to find the bin that holds a wished position; then the values of that bin alone
    are.  So no task sorts a group's values, however large the group, and hot groups are counted on the map side.
    """
    hist = cut_lineage(df.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("g"), F.col(value).cast("bigint").alias("v")).agg(F.count(F.lit(1)).alias("c")), "histogram")
    hist = hist.withColumn("bin", F.floor(F.col("v") / F.lit(QUANTILE_BIN)).cast("bigint"))
    bins = hist.groupBy("g", "bin").agg(F.sum("c").alias("c"))
    upto = W.partitionBy("g").orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    placed = bins.select("g", "bin", (F.sum("c").over(upto) - F.col("c")).alias("lo"), F.sum("c").over(upto).alias("hi"), F.sum("c").over(W.partitionBy("g")).alias("n"))
    tags = [int(round(p * 100)) for p in probs]
    at = [(F.col("n") - 1).cast("double") * F.lit(float(p)) for p in probs]
    wished = F.array(*[F.struct(F.lit(f"{side}{t}").alias("name"), f(x).cast("bigint").alias("position")) for t, x in zip(tags, at) for side, f in (("b", F.floor), ("a", F.ceil))])
    found = placed.select("g", "bin", "lo", "hi", "n", F.inline(wished)).where((F.col("lo") <= F.col("position")) & (F.col("position") < F.col("hi")))
    inside = W.partitionBy("g", "name").orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    ranked = hist.join(found, ["g", "bin"]).withColumn("end", F.col("lo") + F.sum("c").over(inside))
    exact = ranked.where((F.col("end") - F.col("c") <= F.col("position")) & (F.col("position") < F.col("end")))
    wide = exact.groupBy("g").agg(F.max("n").alias("n"), *[F.max(F.when(F.col("name") == f"{side}{t}", F.col("v"))).alias(f"{side}{t}") for t in tags for side in "ba"])
    return wide.select(F.col("g").alias(group), *[
        (F.col(f"b{t}") + (F.col(f"a{t}") - F.col(f"b{t}")) * (x - F.floor(x))).alias(f"q{t}") for t, x in zip(tags, at)])


def distribution(daily: DataFrame) -> DataFrame:
    """Count, mean, deviation, quartiles and extremes of the price per crop (rupees)."""
    base = daily.groupBy("crop").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y_cents").alias("s"), F.stddev_samp("y_cents").alias("sd"),
        F.min("y_cents").alias("lo"), F.max("y_cents").alias("hi"))
    q = exact_quantiles(daily, "crop", "y_cents", [0.25, 0.5, 0.75])
    return base.join(q, "crop").select(
        "crop", F.col("n").alias("row_count"),
        N.round_to(F.col("s").cast("double") / F.col("n") / F.lit(100.0), 4).alias("mean_price"),
        N.round_to(F.col("sd") / F.lit(100.0), 4).alias("std_price"), N.rupees(F.col("lo")).alias("min_price"),
        *[N.round_to(F.col(f"q{t}") / F.lit(100.0), 4).alias(f"p{t}") for t in (25, 50, 75)],
        N.rupees(F.col("hi")).alias("max_price"))


def iqr_outliers(daily: DataFrame, k: float = 1.5) -> DataFrame:
    """Rows per crop outside ``k`` interquartile ranges.

    Works on the value histogram joined to one row per crop, so the hot crop is
    never joined row by row.
    """
    q = exact_quantiles(daily, "crop", "y_cents", [0.25, 0.75])
    hist = daily.groupBy("crop", "y_cents").agg(F.count(F.lit(1)).alias("c"))
    iqr = F.col("q75") - F.col("q25")
    out = (F.col("y_cents") < F.col("q25") - F.lit(k) * iqr) | (F.col("y_cents") > F.col("q75") + F.lit(k) * iqr)
    per = hist.join(q, "crop").groupBy("crop").agg(
        F.sum(F.when(out, F.col("c")).otherwise(0)).alias("outliers"), F.sum("c").alias("n"))
    return per.select("crop", "outliers",
                      N.round_to(F.col("outliers") * F.lit(100.0) / F.col("n"), 2).alias("outlier_pct"))


def correlations(features: DataFrame, columns: Sequence[str], group: str = "crop") -> DataFrame:
    """Pearson correlation of every pair of columns per group, in one aggregation.

    Spark merges the moments about the running means, so no digits are lost however many rows there are.
    """
    cols = list(columns)
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    x = [F.col(c).cast("double") for c in cols]
    wide = features.groupBy(group).agg(*[F.corr(x[i], x[j]).alias(f"r{i}_{j}") for i, j in pairs])
    entries = F.array(*[F.struct(F.lit(cols[i]).alias("feature_a"), F.lit(cols[j]).alias("feature_b"),
                                 N.round_to(F.col(f"r{i}_{j}"), 6).alias("correlation")) for i, j in pairs])
    return wide.select(group, F.inline(entries))


def latest_price(quotes: DataFrame, as_of: Column, ttl_days: int = 3) -> DataFrame:
    """Latest price per key with its age; older than the limit is kept but marked stale."""
    last = quotes.groupBy(*SERIES).agg(
        F.max_by(F.struct("ds", "modal_cents", "market"), F.struct("ds", "market", "modal_cents")).alias("b"))
    age = D.age_days(as_of, F.col("b.ds"))
    return last.select(
        *SERIES, N.rupees(F.col("b.modal_cents")).alias("price"), F.col("b.market").alias("market"),
        F.col("b.ds").alias("arrival_date"), age.cast("bigint").alias("data_age_days"),
        D.ladder(age, "quote").alias("freshness_label"), (age >= ttl_days).alias("stale"))


def price_source_chain(keys: DataFrame, batch: DataFrame, cache: DataFrame, futures: DataFrame,
                       run_ts: Column, usd_inr: float = 83.5) -> DataFrame:
    """Current price per (crop, state) from the best source that has one.

    Order: fresh batch, cache younger than three days (own state, then "All"),
    futures conversion, support price.  All sources are keyed by the pair, so
    the chain is three equi joins and a coalesce; none is short-circuited.
    """
    spark = keys.sparkSession
    hours = N.round_to((F.unix_micros(run_ts) - F.unix_micros("ts")).cast("double") / F.lit(3600000000.0), 1)
    live = cache.withColumn("age_h", hours).where(
        F.unix_micros(run_ts) - F.unix_micros("ts") < F.lit(3 * 86400 * 1_000_000))
    own = live.select("crop", "state", F.struct("price", "age_h").alias("own"))
    every = live.where(F.col("state") == "All").select("crop", F.struct("price", "age_h").alias("every"))
    units = dims.frame(spark, [(c, u, k) for c, (u, k) in dims.FUTURES_UNITS.items()], "crop string, unit string, kg double")
    fx = futures.join(units, "crop").select("crop", F.col("price").alias("f_price"), "unit", "kg")
    factor = F.coalesce(_factor("state", dims.FUTURES_STATE_FACTORS), F.lit(1.0))
    s_factor = F.coalesce(_factor("state", dims.SUPPORT_STATE_FACTORS), F.lit(1.0))
    base = F.coalesce(_number("crop", dims.SUPPORT_PRICES), F.lit(float(dims.SUPPORT_DEFAULT)))
    joined = (keys.join(batch.select(*SERIES, F.col("price").alias("b_price")), SERIES, "left")
              .join(own, SERIES, "left").join(every, "crop", "left").join(fx, "crop", "left"))
    converted = N.futures_to_quintal(F.col("f_price"), F.col("unit"), F.col("kg"), F.lit(float(usd_inr)), factor)
    cached = F.coalesce(F.col("own"), F.col("every"))
    none = F.lit(None).cast("double")

    def row(source: str, price: Column, quality: Column, age: Column) -> Column:
        return F.struct(price.alias("price"), F.lit(source).alias("source"), quality.alias("quality"), age.alias("age"))

    best = (F.when(F.col("b_price").isNotNull(), row("api_batch", F.col("b_price"), F.lit("fresh"), F.lit(0.0)))
            .when(cached.isNotNull(), row("cached_api", cached["price"], D.cache_quality(cached["age_h"]), cached["age_h"]))
            .when(F.col("f_price") > 0, row("futures", converted, F.lit("fresh"), F.lit(0.0)))
            .otherwise(row("support_price", N.support_price(base, s_factor, dims.SUPPORT_FLOOR), F.lit("estimated"), none)))
    return joined.select(*SERIES, best.alias("p")).select(
        *SERIES, F.col("p.price").alias("current_price"), F.col("p.source").alias("data_source"),
        F.col("p.quality").alias("data_quality"), F.col("p.age").alias("data_age_hours"))


def _factor(c: str, table: dict) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.lower(c))


def _number(c: str, table: dict) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, float(v))]), F.col(c))


def current_price(latest: DataFrame, tail: DataFrame, fallback_age: int = 7) -> DataFrame:
    """Keyed latest price, else the last value of the series tail marked as a fallback."""
    last = F.element_at("tail", -1)
    joined = tail.join(latest.select(*SERIES, "price", "arrival_date", "data_age_days", "freshness_label", "stale"),
                       SERIES, "left")
    live = F.col("price").isNotNull() & ~F.col("stale")
    return joined.select(
        *SERIES, F.when(live, F.col("price")).otherwise(N.rupees(last["y_cents"])).alias("current_price"),
        F.when(live, F.col("arrival_date")).otherwise(last["ds"]).alias("price_date"),
        F.when(live, F.col("data_age_days")).otherwise(F.lit(fallback_age).cast("bigint")).alias("data_age_days"),
        F.when(live, F.upper("freshness_label")).otherwise(F.lit("FALLBACK")).alias("market_data_status"))


def weekly_mean(daily: DataFrame) -> DataFrame:
    """Mean per week and series, labelled with the Sunday that ends the week."""
    week = F.next_day(F.date_sub("ds", 1), "SUN")
    per = daily.groupBy(*SERIES, week.alias("week_end")).agg(
        F.sum("y_cents").alias("s"), F.count(F.lit(1)).alias("n"))
    return per.select(*SERIES, "week_end", (F.col("s").cast("double") / F.col("n") / F.lit(100.0)).alias("y"))


def weeks_to_days(weekly: DataFrame, horizon: int, value: str = "y", week: str = "step") -> DataFrame:
    """Each weekly value repeated for seven days, cut to the horizon."""
    day = F.col(week) * 7 + F.col("d")
    return (weekly.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(6))))
            .where(day < horizon).select(*SERIES, day.cast("bigint").alias("day"), value))
