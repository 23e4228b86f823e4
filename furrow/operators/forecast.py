"""Forecast paths, their summaries and the decisions taken from them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from furrow.functions import numeric as N
from furrow.functions import scoring as R

SERIES = ["crop", "state"]
LINEAR_TERMS = ["lag_1", "lag_7", "lag_14", "lag_30", "rolling_7", "rolling_30"]


# ------------------------------------------------------------------- metrics
def millionths(c: Column) -> Column:
    """Rupees as whole millionths; their sums are exact in any order."""
    return N.whole(c * F.lit(1e6))


def regression_metrics(rows: DataFrame, by: Sequence[str], actual: str = "y", predicted: str = "yhat") -> DataFrame:
    """MAE, RMSE, MAPE (divisor at least one) and R2 per group in one aggregation.

    Errors, their squares and relative errors are summed as whole numbers and divided once,
    so the order of the rows never decides a rounding.
    """
    exact = lambda c: c.cast("decimal(19,0)")
    whole = rows.where(F.col(predicted).isNotNull()).select(*by, millionths(F.col(actual)).alias("y_m"), millionths(F.col(predicted)).alias("p_m"), N.cents(F.col(actual)).alias("y_c"))
    e = whole.select(*by, "y_c", F.abs(F.col("y_m") - F.col("p_m")).alias("e"), F.greatest("y_m", F.lit(1_000_000)).cast("double").alias("base"))
    g = e.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(exact(F.col("e"))).cast("double").alias("e1"), F.sum(exact(F.col("e")) * exact(F.col("e"))).cast("double").alias("e2"),
        F.sum(exact(N.whole(F.col("e").cast("double") / F.col("base") * F.lit(1e9)))).cast("double").alias("ratio"),
        F.sum(exact(F.col("y_c"))).cast("decimal(38,0)").alias("s1"), F.sum(exact(F.col("y_c")) * exact(F.col("y_c"))).alias("s2"))
    n = F.col("n").cast("double")
    spread = (F.col("s2") * F.col("n").cast("decimal(18,0)") - F.col("s1") * F.col("s1")).cast("double") / (n * n) / F.lit(1e4)
    mse = F.col("e2") / n / F.lit(1e12)
    return g.select(
        *by, F.col("n").alias("row_count"), N.round_to(F.col("e1") / n / F.lit(1e6), 2).alias("mae"), N.round_to(F.sqrt(mse), 2).alias("rmse"),
        N.round_to(F.col("ratio") / n / F.lit(1e7), 2).alias("mape"),
        N.round_to(F.lit(1.0) - mse / F.nullif(spread, F.lit(0.0)), 4).alias("r2"))


def long_predictions(features: DataFrame, models: Mapping[str, str], keep: Sequence[str] = ("crop", "state", "ds", "y")) -> DataFrame:
    """One row per model from columns that already hold its prediction."""
    entries = F.array(*[F.struct(F.lit(name).alias("model"), F.col(c).alias("yhat")) for name, c in models.items()])
    return features.select(*keep, F.inline(entries))


def best_models(metrics: DataFrame, primary: str | None = None) -> DataFrame:
    """Model of least error per crop; a primary model wins only if strictly better than every other."""
    others = metrics if primary is None else metrics.where(F.col("model") != primary)
    best = others.groupBy("crop").agg(F.min_by(F.struct("model", "mae"), F.struct("mae", "model")).alias("b"))
    if primary is None:
        return best.select("crop", F.col("b.model").alias("best_model"), F.col("b.mae").alias("best_mae"))
    p = metrics.where(F.col("model") == primary).select("crop", F.col("mae").alias("p_mae"))
    wins = F.col("p_mae") < F.col("b.mae")
    return best.join(p, "crop", "left").select(
        "crop", F.when(wins, F.lit(primary)).otherwise(F.col("b.model")).alias("best_model"),
        F.when(wins, F.col("p_mae")).otherwise(F.col("b.mae")).alias("best_mae"))


def comparison_table(metrics: DataFrame) -> DataFrame:
    """Every model of a crop with a flag on the best one."""
    return metrics.join(best_models(metrics), "crop").withColumn("is_best", F.col("model") == F.col("best_model")).drop("best_model", "best_mae")


# ------------------------------------------------------------ linear forecasts
#: Moments are sums of whole thousandths of a rupee, exact in any order.
UNIT = 1000.0


def eliminated(matrix: Column, size: int) -> Column:
    """Gauss-Jordan elimination of an array of rows without row exchange: for positive definite matrices.

    After step p the p-th column is that of the unit matrix; what stands beyond ``size`` is the solution.
    """
    def step(m: Column, p: Column) -> Column:
        pivot = F.get(m, p)
        norm = F.transform(pivot, lambda x: x / F.get(pivot, p))
        return F.transform(m, lambda row, i: F.when(i == p, norm).otherwise(F.zip_with(row, norm, lambda x, y: x - F.get(row, p) * y)))

    return F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), matrix, step)


def ridge_by_crop(features: DataFrame, terms: Sequence[str] = tuple(LINEAR_TERMS), penalty: float = 1.0, by: str = "crop") -> DataFrame:
    """Ridge coefficients of every crop from one pass of sums, solved by array expressions.

    The rows are reduced to (terms + 1)^2 whole-number sums per crop by partial aggregation, so the
    result depends neither on the order nor on the partitions of the rows.  A price must be
    below three million rupees, or the products do not fit and the query fails.
    """
    cols = [*terms, "y"]
    k = len(terms)
    scaled = features.select(by, *[N.whole(F.col(c) * F.lit(UNIT)).alias(f"v_{i}") for i, c in enumerate(cols)])
    sums = [F.count(F.lit(1)).cast("decimal(18,0)").alias("n")] + [F.sum(F.col(f"v_{i}").cast("decimal(19,0)")).cast("decimal(28,0)").alias(f"s_{i}") for i in range(k + 1)]
    sums += [F.sum((F.col(f"v_{i}") * F.col(f"v_{j}")).cast("decimal(19,0)")).cast("decimal(28,0)").alias(f"q_{i}_{j}") for i in range(k + 1) for j in range(i, k + 1)]
    reduced = scaled.groupBy(by).agg(*sums)
    n = F.col("n").cast("double")

    def spread(i: int, j: int) -> Column:
        """Sum of the products of what is left of two columns without their means."""
        exact = F.col("n").cast("decimal(10,0)") * F.col(f"q_{min(i, j)}_{max(i, j)}") - F.col(f"s_{i}").cast("decimal(19,0)") * F.col(f"s_{j}").cast("decimal(19,0)")
        return exact.cast("double") / n / F.lit(UNIT * UNIT)

    rows = F.array(*[F.array(*[spread(i, j) + F.lit(penalty if i == j else 0.0) for j in range(k + 1)]) for i in range(k)])
    mean = lambda i: F.col(f"s_{i}").cast("double") / n / F.lit(UNIT)
    solved = reduced.select(by, F.array(*[mean(i) for i in range(k + 1)]).alias("means"), F.transform(eliminated(rows, k), lambda r: F.get(r, F.lit(k))).alias("coefficients"))
    intercept = F.get("means", F.lit(k))
    for i in range(k):
        intercept = intercept - F.get("coefficients", F.lit(i)) * F.get("means", F.lit(i))
    return solved.select(by, intercept.alias("intercept"), "coefficients")


def with_linear_prediction(features: DataFrame, models: DataFrame, terms: Sequence[str] = tuple(LINEAR_TERMS), by: str = "crop") -> DataFrame:
    """Adds ``yhat``; the model table has one row per fitted crop."""
    total = F.col("intercept")
    for i, t in enumerate(terms):
        total = total + F.col("coefficients")[i] * F.col(t)
    return features.join(models, by).withColumn("yhat", total).drop("intercept", "coefficients")


def seed_prices(tails: DataFrame, live: DataFrame | None = None, least: int = 15, pad_to: int = 30, base: float = 2000.0) -> DataFrame:
    """Price array of each series to start from.

    Short tails become a constant at the live price (or ``base``); otherwise the
    live price replaces the last value.  Arrays shorter than ``pad_to`` are
    filled in front with their first value.
    """
    t = tails.select(*SERIES, F.transform("tail", lambda r: r["y_cents"].cast("double") / F.lit(100.0)).alias("p"),
                     F.aggregate("tail", F.lit(0.0), lambda a, r: a + r["range_cents"].cast("double"), lambda a: a).alias("rs"),
                     F.element_at("tail", -1)["ds"].alias("last_ds"))
    if live is None:
        t = t.withColumn("live", F.lit(None).cast("double"))
    else:
        t = t.join(live.select(*SERIES, F.col("price").alias("live")), SERIES, "left")
    enough = F.size("p") >= least
    price = F.when(F.col("live") > 0, F.col("live"))
    constant = F.array_repeat(F.coalesce(price, F.lit(float(base))), pad_to)
    seeded = F.when(price.isNotNull(), F.concat(F.slice("p", F.lit(1), F.size("p") - 1), F.array(price))).otherwise(F.col("p"))
    missing = F.greatest(F.lit(pad_to) - F.size("p"), F.lit(0))
    padded = F.concat(F.array_repeat(F.col("p")[0], missing), seeded)
    return t.select(*SERIES, "last_ds", F.when(enough, padded).otherwise(constant).alias("prices"),
                    F.when(enough, F.col("rs") / F.size("p") / F.lit(100.0)).otherwise(F.lit(0.0)).alias("mean_range"))


def _mean_last(prices: Column, k: int) -> Column:
    return F.aggregate(F.slice(prices, -k, k), F.lit(0.0), lambda a, x: a + x) / F.lit(float(k))


def recursive_linear(seeds: DataFrame, horizon: int = 30, floor: float | None = None) -> DataFrame:
    """Path of a linear model on lags and means of its own output, never below ``floor``.

    ``seeds``: crop, state, prices (at least 30), intercept, coefficients in the
    order of ``LINEAR_TERMS``.  Everything is array functions, so each series is
    one row of ordinary work.
    """
    c = F.col("coefficients")

    def step(acc: Column, i: Column) -> Column:
        total = (F.col("intercept") + c[0] * F.element_at(acc, -1) + c[1] * F.element_at(acc, -7) + c[2] * F.element_at(acc, -14)
                 + c[3] * F.element_at(acc, -30) + c[4] * _mean_last(acc, 7) + c[5] * _mean_last(acc, 30))
        return F.concat(acc, F.array(total if floor is None else F.greatest(total, F.lit(float(floor)))))

    path = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), F.col("prices"), step)
    return seeds.withColumn("path", F.slice(path, -horizon, horizon))


def dated_path(paths: DataFrame, start: Column, keep: Sequence[str] = tuple(SERIES)) -> DataFrame:
    """Long form of a path: step from one, day from ``start`` on, exactly as many rows as points."""
    long = paths.select(*keep, start.alias("start"), F.posexplode("path").alias("i", "yhat"))
    return long.select(*keep, (F.col("i") + 1).cast("bigint").alias("step"), F.date_add("start", F.col("i")).alias("ds"),
                       N.round_to(F.col("yhat"), 2).alias("yhat"))


# ----------------------------------------------------------------- back-test
def monthly_origins(daily: DataFrame, least: int = 15, pad_to: int = 30, ahead: int = 30) -> DataFrame:
    """A row for each series and month: the prices before the month, and the days from its first on.

    A series is one ordered array, and an origin is a position in it: the first row of a month,
    if at least ``least`` rows stand before it.  Only slices leave the array, so no origin is
    joined back to the series.  Fewer than ``pad_to`` prior rows are filled in front with the first.
    """
    rows = F.array_sort(F.collect_list(F.struct("ds", "y_cents")))
    month = lambda i: F.trunc(F.get("rows", i)["ds"], "month")
    starts = F.filter(F.sequence(F.lit(least), F.size("rows") - 1), lambda i: month(i) != month(i - 1))
    series = daily.groupBy(*SERIES).agg(rows.alias("rows")).where(F.size("rows") > least)
    at = series.select(*SERIES, "rows", F.explode(starts).alias("k"))
    prior = F.slice("rows", F.greatest(F.col("k") - pad_to, F.lit(0)) + 1, F.least("k", F.lit(pad_to)))
    cut = at.select(*SERIES, month(F.col("k")).alias("origin"), F.transform(prior, lambda r: N.rupees(r["y_cents"])).alias("p"), F.slice("rows", F.col("k") + 1, ahead).alias("after"))
    return cut.select(*SERIES, "origin", F.concat(F.array_repeat(F.get("p", F.lit(0)), F.lit(pad_to) - F.size("p")), F.col("p")).alias("prices"), "after")


def backtest(paths: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """crop, state, origin, horizon, yhat and y for every horizon whose day the series has.

    ``paths`` are origins with a ``path`` that starts on the origin's day.
    """
    def point(h: int) -> Column:
        day = F.date_add("origin", h - 1)
        real = F.get(F.filter("after", lambda r: r["ds"] == day), F.lit(0))["y_cents"]
        return F.struct(F.lit(h).cast("bigint").alias("horizon"), N.round_to(F.get("path", F.lit(h - 1)), 2).alias("yhat"), N.rupees(real).alias("y"))

    return paths.select(*SERIES, "origin", F.inline(F.array(*[point(h) for h in horizons]))).where("y IS NOT NULL")


def horizon_metrics(tested: DataFrame, cuts: tuple[float, float] = (7.0, 15.0)) -> DataFrame:
    """Error at each true horizon per crop over all origins, with a rating by percentage error."""
    m = regression_metrics(tested, ["crop", "horizon"])
    rating = F.when(F.col("mape") < cuts[0], "HIGH").when(F.col("mape") < cuts[1], "MODERATE").otherwise("UNCERTAIN")
    return m.withColumn("reliability_rating", rating)


# ----------------------------------------------------------------- summaries
def forecast_summary(forecasts: DataFrame, horizons: Sequence[int] = (7, 15, 30, 60, 90)) -> DataFrame:
    """First, last, extremes, mean of 30 days and means of the first 7 to 90 days per series."""
    y, s = F.col("yhat"), F.col("step")
    cents = N.cents(y)

    def mean(limit: int) -> Column:
        within = F.when(s <= limit, cents)
        return N.round_to(F.sum(within).cast("double") / F.count(within) / F.lit(100.0), 2)

    month = s <= 30
    return forecasts.groupBy(*SERIES).agg(
        F.min_by(y, s).alias("starting_price"), F.max_by(F.when(month, y), F.when(month, s)).alias("ending_price"),
        F.max(F.when(month, y)).alias("highest_price"), F.min(F.when(month, y)).alias("lowest_price"), mean(30).alias("average_price"),
        *[mean(h).alias(f"mean_{h}_day") for h in horizons])


def trend_statistics(forecasts: DataFrame, current: DataFrame) -> DataFrame:
    """Expected change, slope, spread, mean daily move, direction and strength of each path."""
    w = W.partitionBy(*SERIES).orderBy("step")
    y = F.col("yhat")
    d = forecasts.where(F.col("step") <= 30).withColumn("move", F.abs(y - F.lag("yhat").over(w)))
    g = d.groupBy(*SERIES).agg(
        F.avg(y).alias("mean"), F.min(y).alias("low"), F.max(y).alias("high"), F.stddev_pop(y).alias("sd"), F.var_pop(y).alias("var"),
        F.regr_slope(y, F.col("step").cast("double")).alias("slope"), F.avg("move").alias("move"))
    j = g.join(current.select(*SERIES, "current_price"), SERIES)
    cur = F.when(F.col("current_price") > 0, F.col("current_price"))
    change = (F.col("mean") - cur) / cur * F.lit(100.0)
    slope_pct = F.col("slope") / cur * F.lit(100.0)
    vol = F.when(F.col("mean") > 0, F.col("sd") / F.col("mean") * F.lit(100.0)).otherwise(F.lit(0.0))
    return j.select(
        *SERIES, N.round_to(change, 2).alias("expected_change_percent"), N.round_to(F.col("mean"), 2).alias("average_price"),
        N.round_to(F.col("low"), 2).alias("minimum_price"), N.round_to(F.col("high"), 2).alias("maximum_price"),
        N.round_to(F.col("slope"), 2).alias("forecast_slope"), N.round_to(F.coalesce("move", F.lit(0.0)), 2).alias("daily_average_change"),
        N.round_to(F.col("sd"), 2).alias("forecast_std"), N.round_to(F.col("var"), 2).alias("forecast_variance"), N.round_to(vol, 2).alias("volatility_percent"),
        R.trend_direction(change).alias("trend_direction"), R.trend_strength(change, slope_pct).alias("trend_strength"))


def bands(forecasts: DataFrame, rmse: DataFrame, width: float = 1.2, default: float = 50.0, floor: float = 50.0) -> DataFrame:
    """Lower and upper band around each point and the fitted straight line of the series."""
    line = forecasts.groupBy(*SERIES).agg(F.regr_slope("yhat", F.col("step").cast("double")).alias("a"),
                                          F.regr_intercept("yhat", F.col("step").cast("double")).alias("b"))
    j = forecasts.join(line, SERIES).join(rmse.select("crop", "rmse"), "crop", "left")
    margin = F.when(F.col("rmse") > 0, F.col("rmse") * F.lit(width)).otherwise(F.lit(default))
    return j.select(
        *SERIES, "step", "yhat", N.round_to(F.greatest(F.col("yhat") - margin, F.lit(floor)), 2).alias("lower_bound"),
        N.round_to(F.col("yhat") + margin, 2).alias("upper_bound"), N.round_to(F.col("a") * F.col("step") + F.col("b"), 2).alias("trend_line"))


def candidate_gate(forecasts: DataFrame, metrics: DataFrame, steps: int = 30, spike: float = 3.5, slack: float = 1.10) -> DataFrame:
    """PROMOTE or REJECT per crop, with the first failed check as the reason.

    ``metrics``: crop, candidate_mae, production_mae (null if there is none).
    """
    per_series = forecasts.groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("n"), F.min("yhat").alias("low"), F.max("yhat").alias("high"), F.min_by("yhat", "step").alias("first"))
    per = per_series.groupBy("crop").agg(
        F.bool_and(F.col("n") == steps).alias("complete"), F.bool_and(F.col("low") > 0).alias("positive"),
        F.bool_and(F.col("high") <= F.col("first") * F.lit(spike)).alias("calm"))
    j = metrics.join(per, "crop", "left")
    worse = F.coalesce(F.col("candidate_mae") > F.col("production_mae") * F.lit(slack), F.lit(False))
    reason = (F.when(~F.coalesce("complete", F.lit(False)), "FORECAST_INCOMPLETE").when(~F.col("positive"), "NON_POSITIVE_PRICE")
              .when(~F.col("calm"), "EXTREME_SPIKE").when(worse, "WORSE_THAN_PRODUCTION").otherwise("PASSED"))
    return j.select("crop", F.when(reason == "PASSED", "PROMOTE").otherwise("REJECT").alias("decision"), reason.alias("reason"),
                    "candidate_mae", "production_mae")


# ----------------------------------------------------------------- decisions
# Sentences of the reasons.  Fixed values.
REASON_OLD = ("The latest Mandi price observation is ", " days old. Market conditions may have changed. Verify current local Mandi rates before making a transaction decision.")
REASON_SMALL = ("The ", "-day forecast indicates a marginal movement of ", "% — within model uncertainty bounds. Prices are expected to remain relatively stable.")
REASON_DOWN = ("The ", "-day forecast indicates a price decline of approximately ", "% from Rs.", " to Rs.", ". Selling at the current observed Mandi price may reduce downside risk.")
REASON_UP = ("The ", "-day forecast indicates a price increase of approximately ", "% from Rs.", " to Rs.", ". Holding may provide a better expected selling price.")
REASON_EVENT = ("An active market disruption (", ") introduces significant price uncertainty. Verify local conditions before acting.")


def decision_reason(decision: Column, plain: Column, current: Column, predicted: Column, change: Column, age_days: Column, event: Column, horizon: int = 30) -> Column:
    """Why the outlook says what it says; null without a decision."""
    moved = N.round_to(change, 1)
    days = str(horizon)
    both = [F.lit(REASON_DOWN[2]), rupee_text(current), F.lit(REASON_DOWN[3]), rupee_text(predicted)]
    return (F.when(decision.isNull(), F.lit(None).cast("string"))
            .when(F.coalesce(age_days > 14, F.lit(False)), F.concat(F.lit(REASON_OLD[0]), age_days.cast("string"), F.lit(REASON_OLD[1])))
            .when((decision == "WAIT") & (plain == "HOLD"), F.concat(F.lit(REASON_EVENT[0]), F.coalesce(event, F.lit("unnamed")), F.lit(REASON_EVENT[1])))
            .when(decision == "WAIT", F.concat(F.lit(REASON_SMALL[0] + days + REASON_SMALL[1]), F.format_string("%+.1f", moved), F.lit(REASON_SMALL[2])))
            .when(decision == "SELL", F.concat(F.lit(REASON_DOWN[0] + days + REASON_DOWN[1]), F.format_string("%.1f", F.abs(moved)), *both, F.lit(REASON_DOWN[4])))
            .otherwise(F.concat(F.lit(REASON_UP[0] + days + REASON_UP[1]), F.format_string("%.1f", moved), *both, F.lit(REASON_UP[4]))))


def decide(outlook: DataFrame, crop_name: Column | None = None) -> DataFrame:
    """All three named rules side by side, with the reason of the first.

    ``outlook``: crop, state, current_price, predicted_price, data_age_days,
    disrupted (boolean), event (its name), available (boolean).  ``crop_name`` is the name that
    the rules know the crop by, if the series are called otherwise.
    """
    name = F.col("crop") if crop_name is None else crop_name
    cur, pred = F.col("current_price"), F.col("predicted_price")
    change = N.round_to(R.change_pct(F.when(cur > 0, cur), pred), 2)
    o = outlook.withColumn("change_percent", change)
    ch, age = F.col("change_percent"), F.col("data_age_days")
    rules = o.select(
        *outlook.columns, "change_percent", F.when(F.col("available"), R.outlook_decision(name, ch, age, F.col("disrupted"))).alias("recommendation"),
        F.when(F.col("available"), R.plain_decision(name, ch, age)).alias("plain_recommendation"),
        R.advisory_action(cur, pred, F.col("available")).alias("advisory_action"), R.storage_decision(ch).alias("storage_decision"), R.net_gain(ch).alias("net_gain_percent"))
    return rules.withColumn("recommendation_reason", decision_reason(F.col("recommendation"), F.col("plain_recommendation"), cur, pred, ch, age, F.col("event")))


# Sentences of the advisory action, the storage decision and the reasons list.  Fixed values.
ADVICE_NONE = "A reliable 30-day price forecast is currently unavailable for this crop."
ADVICE_NO_PRICE = "Current mandi price is unavailable. Cannot generate a market decision without a confirmed price reference."
ADVICE_DOWN = ("Forecast indicates a price decline of approximately ", "% over the next 30 days. Selling now minimizes downside risk.")
ADVICE_UP = ("Prices are forecast to appreciate by approximately ", "% over the next 30 days. Holding may capture higher value.")
ADVICE_FLAT = ("Price is expected to remain stable within ±", "%. Monitor market developments.")
STORAGE_UP = ("Predicted price increase (", "%) significantly exceeds estimated 30-day storage costs (", "%). Holding inventory is profitable.")
STORAGE_DOWN = ("Predicted price decrease (", "%) indicates an downward market. Selling immediately is recommended to lock in current market prices.")
STORAGE_FLAT = ("Predicted price change (", "%) does not yield net gain after accounting for estimated 30-day holding and storage decay costs (", "%). Selling recommended.")
TREND_UP = ("Historical trend analysis indicates an UPWARD trajectory (+", "% expected over 30 days).")
TREND_DOWN = ("Historical trend analysis indicates a DOWNWARD trajectory (", "% expected over 30 days).")
TREND_FLAT = ("Historical trend analysis indicates a STABLE price pattern (", "% 30-day forecast variance).")
GAIN_HOLD = ("Net gain after 30-day storage costs (", "%) is estimated at +", "%.")
GAIN_SELL = ("Holding crop for 30 days incurs an estimated ", "% storage & shrink cost, yielding net gain of ", "%.")
SEASON_TEXTS = {("Wheat", "Potato"): " pricing reflects Winter Season harvest market patterns based on 6-year history.",
                ("Rice", "Maize"): " pricing reflects Rainy Season crop arrival cycles based on 6-year history."}
SEASON_OTHER = " displays historical seasonal trading behavior in national agricultural markets."
CLIMATE_TEXT = ("Regional climate proxy conditions (", "°C avg temp, ", "mm monthly rainfall) align with standard seasonal supply expectations.")


def _sentence(parts: Sequence[str], *values: Column) -> Column:
    """Texts and values in turn."""
    pieces = [x for pair in zip(map(F.lit, parts), values) for x in pair]
    return F.concat(*pieces, *map(F.lit, parts[len(values):]))


def decision_reasons(decisions: DataFrame, crop_name: Column, storage: float = 2.0) -> DataFrame:
    """Why the advisory action and the storage decision are what they are, and the list of reasons.

    ``decisions`` as ``decide`` returns them, with ``avg_temp`` and ``total_rainfall`` of the target month (null: no
    climate reason).  Without a forecast there is no storage reason and no list.
    """
    ch, gain, action = F.col("change_percent"), F.col("net_gain_percent"), F.col("advisory_action")
    plain, signed = (lambda c: F.format_string("%.1f", N.round_to(c, 1))), (lambda c: F.format_string("%+.1f", N.round_to(c, 1)))
    cost = F.lit(f"{storage:.1f}")
    moved = plain(F.abs(R.change_pct(F.when(F.col("current_price") > 0, F.col("current_price")), F.col("predicted_price"))))
    advice = (F.when(~F.col("available"), F.lit(ADVICE_NONE)).when(action.isNull(), F.lit(ADVICE_NO_PRICE)).when(action == "SELL", _sentence(ADVICE_DOWN, moved))
              .when(action == "HOLD", _sentence(ADVICE_UP, moved)).otherwise(_sentence(ADVICE_FLAT, moved)))
    keep = (F.when(ch > 5.0, _sentence(STORAGE_UP, signed(ch), cost)).when(ch < -5.0, _sentence(STORAGE_DOWN, plain(ch))).otherwise(_sentence(STORAGE_FLAT, signed(ch), cost)))
    direction = R.trend_direction(ch)
    trend = F.when(direction == "UPWARD", _sentence(TREND_UP, plain(ch))).when(direction == "DOWNWARD", _sentence(TREND_DOWN, plain(ch))).otherwise(_sentence(TREND_FLAT, signed(ch)))
    held = F.when(F.col("storage_decision") == "HOLD", _sentence(GAIN_HOLD, cost, plain(gain))).otherwise(_sentence(GAIN_SELL, cost, signed(gain)))
    season = F.lit(SEASON_OTHER)
    for crops, text in SEASON_TEXTS.items():
        season = F.when(crop_name.isin(*crops), F.lit(text)).otherwise(season)
    climate = _sentence(CLIMATE_TEXT, plain(F.col("avg_temp")), plain(F.col("total_rainfall")))
    reasons = F.array_compact(F.array(trend, held, F.concat(crop_name, season), climate))
    known = F.col("available") & ch.isNotNull()
    return decisions.select("crop", "state", "advisory_action", advice.alias("advisory_reason"), "storage_decision", F.when(known, keep).alias("storage_reason"), F.when(known, reasons).alias("reasons"))


def decision_breakdown(decisions: DataFrame) -> DataFrame:
    """Decisions and scopes per crop."""
    d, s = F.col("recommendation"), F.col("forecast_scope")
    return decisions.groupBy("crop").agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(d == x).alias(x.lower()) for x in ("SELL", "HOLD", "WAIT")],
        F.count_if(s == "STATE_CROP").alias("state_crop"), F.count_if(s != "STATE_CROP").alias("fallback"))


def identical_forecasts(decisions: DataFrame) -> DataFrame:
    """Groups of states of one crop with the same forecast; fine only if all are fallbacks."""
    price = N.round_to(F.col("predicted_price"), 1)
    g = decisions.groupBy("crop", price.alias("price")).agg(
        F.count(F.lit(1)).alias("state_count"), F.array_join(F.array_sort(F.collect_list("state")), ",").alias("states"),
        F.bool_and(F.col("forecast_scope") == "CROP_ONLY").alias("acceptable"))
    return g.where(F.col("state_count") > 1)


def state_specificity(decisions: DataFrame) -> DataFrame:
    per = decisions.groupBy("crop", N.round_to(F.col("predicted_price"), 0).alias("p")).agg(
        F.count(F.lit(1)).alias("n"), F.min("predicted_price").alias("lo"), F.max("predicted_price").alias("hi"))
    g = per.groupBy("crop").agg(F.sum("n").alias("total_predictions"), F.count(F.lit(1)).alias("unique_rounded_values"),
                                F.min("lo").alias("min_predicted"), F.max("hi").alias("max_predicted"))
    return g.select(
        "*", N.round_to(F.col("unique_rounded_values") * F.lit(100.0) / F.col("total_predictions"), 1).alias("pct_state_specific"),
        N.round_to(F.col("max_predicted") - F.col("min_predicted"), 2).alias("state_price_range"))


def extreme_forecasts(decisions: DataFrame, bound: float) -> DataFrame:
    return decisions.where(F.abs("change_percent") > bound).select("crop", "state", "current_price", "predicted_price", "change_percent")


def forecast_spikes(forecasts: DataFrame, factor: float = 3.5) -> DataFrame:
    """First and highest step of each series, and whether any step is beyond ``factor`` times the first or not positive."""
    y = F.col("yhat")
    g = forecasts.groupBy(*SERIES).agg(F.min_by(y, "step").alias("first_price"), F.max(y).alias("highest_price"), F.min(y).alias("lowest_price"))
    return g.select(*SERIES, "first_price", "highest_price", "lowest_price", (F.col("highest_price") > F.col("first_price") * F.lit(factor)).alias("spike"), (F.col("lowest_price") <= 0).alias("not_positive"))


def decision_compliance(decisions: DataFrame, wide: Sequence[str] = ()) -> DataFrame:
    """Decisions that differ from what prices and ages alone ask for, per crop.

    The expectation is worked out here from the prices; ``wide`` names the crops whose
    threshold is five percent.
    """
    change = N.round_to((F.col("predicted_price") - F.col("current_price")) / F.nullif(F.col("current_price"), F.lit(0.0)) * 100.0, 2)
    limit = F.when(F.col("crop").isin(list(wide)), 5.0).otherwise(3.0)
    moves = F.when(F.coalesce(F.col("data_age_days") > 14, F.lit(False)), 0).when(change <= -limit, -1).when(change >= limit, 1).otherwise(0)
    expected = F.element_at(F.array(F.lit("SELL"), F.lit("WAIT"), F.lit("HOLD")), moves + 2)
    ok = F.col("recommendation").eqNullSafe(F.when(F.col("available"), expected))
    return decisions.groupBy("crop").agg(F.count(F.lit(1)).alias("checked"), F.count_if(~ok).alias("mismatches"))


def forecast_grid(decisions: DataFrame, crops: Sequence[str]) -> DataFrame:
    """State by crop matrix of decisions; the crop list is given, so no extra pass finds it."""
    return decisions.groupBy("state").pivot("crop", list(crops)).agg(F.first("recommendation"))


def quality_matrix(coverage: DataFrame, metrics: DataFrame, horizon: int = 30) -> DataFrame:
    """Tier, confidence level and percentage error of each (state, crop)."""
    n = F.col("record_count")
    tier = F.when(n >= 200, "STATE_CROP_MODEL").when(n >= 50, "STATE_AWARE_FALLBACK").otherwise("CROP_LEVEL_FALLBACK")
    level = F.when(n >= 200, "HIGH").when(n >= 50, "MODERATE").otherwise("LOW_PROVABLY_NATIONAL")
    m = metrics.where(F.col("horizon") == horizon).select("crop", F.col("mape").alias("estimated_mape"))
    return coverage.join(m, "crop", "left").select("state", "crop", "record_count", tier.alias("forecast_tier"), level.alias("confidence_level"), "estimated_mape")


# --------------------------------------------------------------------- texts
def rupee_text(c: Column) -> Column:
    return F.format_number(N.whole(c), 0)


# Sentences of the price analysis.  Fixed values.
PRICE_HEAD = ("Mandi price at ", " was Rs.", "/quintal (", "). ")
PRICE_SELL = ("The 30-day forecast projects a price decline of ", "% to Rs.", "/quintal. Selling now minimizes downside price risk.")
PRICE_HOLD = ("The 30-day forecast projects price appreciation of ", "% to Rs.", "/quintal. Holding may capture higher value.")
PRICE_WAIT = ("The 30-day forecast projects stable prices around Rs.", "/quintal (", "% change).")
PRICE_NONE = "A reliable 30-day price forecast is currently unavailable for this crop."


def price_texts(decisions: DataFrame, market: str = "market") -> DataFrame:
    """Plain sentence for each outlook; no scores or model names."""
    cur, pred = F.col("current_price"), F.col("predicted_price")
    ch = N.round_to(F.col("change_percent"), 1)
    head = _sentence(PRICE_HEAD, F.col(market), rupee_text(cur), F.date_format("observation_date", "dd-MM-yyyy"))
    action = F.col("recommendation")
    text = (F.when(action == "SELL", F.concat(head, _sentence(PRICE_SELL, F.format_string("%.1f", F.abs(ch)), rupee_text(pred))))
            .when(action == "HOLD", F.concat(head, _sentence(PRICE_HOLD, F.format_string("%+.1f", ch), rupee_text(pred))))
            .when(action == "WAIT", F.concat(head, _sentence(PRICE_WAIT, rupee_text(pred), F.format_string("%+.1f", ch))))
            .otherwise(F.lit(PRICE_NONE)))
    return decisions.withColumn("analysis", text)


# Columns a public result may carry.  Fixed values.
PUBLIC_COLUMNS = ["available", "crop", "state", "current_price", "predicted_price", "horizon_days", "observation_date", "market_name",
                  "data_age_days", "recommendation", "recommendation_reason"]


def public_view(results: DataFrame) -> DataFrame:
    """Only the public columns, in their fixed order; one that is absent is an error."""
    return results.select(*PUBLIC_COLUMNS)
