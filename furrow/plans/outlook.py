"""Forecast, decision and report queries over the daily series."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow import dims
from furrow.functions import numeric as N
from furrow.functions import scoring as R
from furrow.functions import text as X
from furrow.operators import features as ft
from furrow.operators import forecast as fc
from furrow.operators import prices
from furrow.plans import features as PF
from furrow.plans import prices as PR
from furrow.plans import sql as S
from furrow.plans.prices import daily, stored_daily
from furrow.session import cut_lineage
from furrow.sources import tables as T

# Coefficients of the model that the back-test runs over all months, so that no month was fitted on: fixed values.
INTERCEPT, COEFFICIENTS = 25.0, [0.5, 0.15, 0.1, 0.05, 0.1, 0.08]
HORIZONS = (1, 7, 15, 30)
MODELS = {"naive_lag1": "lag_1", "moving_average_30": "rolling_30", "moving_average_7": "rolling_7", "weekly_lag": "lag_7"}


def _cut():
    return F.lit(T.SPLIT_DATE).cast("date")


def holdout(spark, sf):
    f = ft.lag_features(daily(spark, sf), PF.SPANS)
    return f.where(F.col("ds") >= F.lit(T.SPLIT_DATE).cast("date"))


def metrics(spark, sf):
    return fc.regression_metrics(fc.long_predictions(holdout(spark, sf), MODELS), ["crop", "model"])


def fitted(spark, sf, d):
    """Ridge model of every crop on the days before the split."""
    features = ft.lag_features(d, PF.SPANS)
    return fc.ridge_by_crop(features.where(F.col("ds") < _cut()))


def seeds(spark, sf, d=None):
    """Tails before the split, the last value replaced by the dearest quote of the last day, with the crop's fitted model.

    ``d`` is the stored daily series, if there is one already.  A crop without a model keeps its series, without a forecast.
    """
    d = stored_daily(spark, sf) if d is None else d
    q = T.quotes(spark, sf).where(F.col("ds") < _cut())
    per = q.groupBy("crop", "state", "ds").agg(F.max("modal_cents").alias("m"))
    live = per.groupBy("crop", "state").agg(F.max_by("m", "ds").alias("m")).select("crop", "state", N.rupees(F.col("m")).alias("price"))
    s = fc.seed_prices(ft.series_tail(d.where(F.col("ds") < _cut())), live)
    return s.join(fitted(spark, sf, d), "crop", "left")


def forecasts(spark, sf):
    return path_rows(spark, sf)


#: Crops of the series whose names the rules know as uncertain.
WIDE = [t.lower() for t, name in T.TYPE_CROPS.items() if name.lower() in dims.HIGH_UNCERTAINTY_CROPS]


def path_rows(spark, sf, horizon=30, floor=None):
    """The forecast of every series from the day of the split on."""
    return fc.dated_path(fc.recursive_linear(seeds(spark, sf), horizon, floor), _cut())


def outlook(spark, sf, d=None, paths=None):
    """Latest price and thirty-day forecast of every series, with what the decision depends on."""
    d = stored_daily(spark, sf) if d is None else d
    s = fc.recursive_linear(seeds(spark, sf, d), 30) if paths is None else paths
    n = d.where(F.col("ds") < _cut()).groupBy("crop", "state").agg(F.sum("market_count").alias("record_count"))
    target = F.date_add(_cut(), 29)
    event = F.coalesce(*[F.when(target.between(F.lit(a).cast("date"), F.lit(b).cast("date")), F.lit(label)) for label, a, b, _ in T.FIXTURE_DISRUPTIONS], F.lit(None).cast("string"))
    predicted = N.round_to(F.element_at("path", -1), 2)
    return s.join(n, ["crop", "state"]).select(
        "crop", "state", N.round_to(F.element_at("prices", -1), 2).alias("current_price"), predicted.alias("predicted_price"), F.col("last_ds").alias("observation_date"),
        F.datediff(_cut(), "last_ds").cast("bigint").alias("data_age_days"), event.isNotNull().alias("disrupted"), event.alias("event"), F.coalesce(predicted > 0, F.lit(False)).alias("available"),
        R.forecast_scope(F.col("record_count")).alias("forecast_scope"))


def decisions(spark, sf):
    return fc.decide(outlook(spark, sf), X.lookup(F.col("crop"), {t.lower(): n.lower() for t, n in T.TYPE_CROPS.items()}))


def baseline_metrics(spark, sf):
    return metrics(spark, sf)


def best_model(spark, sf):
    return fc.best_models(metrics(spark, sf), "naive_lag1")


def model_comparison(spark, sf):
    return fc.comparison_table(metrics(spark, sf))


def recursive_forecast(spark, sf):
    return forecasts(spark, sf)


def horizon_metrics(spark, sf):
    """Errors 1, 7, 15 and 30 days ahead, from every month of every series as origin."""
    origins = fc.monthly_origins(daily(spark, sf)).withColumn("intercept", F.lit(INTERCEPT)).withColumn("coefficients", F.array(*[F.lit(c) for c in COEFFICIENTS]))
    return fc.horizon_metrics(fc.backtest(fc.recursive_linear(origins, 30), HORIZONS))


def forecast_summary(spark, sf):
    return fc.forecast_summary(path_rows(spark, sf, 90, 100.0))


def trend_statistics(spark, sf):
    d = stored_daily(spark, sf)
    paths = cut_lineage(fc.recursive_linear(seeds(spark, sf, d), 30), "paths")
    return fc.trend_statistics(fc.dated_path(paths, _cut()), outlook(spark, sf, d, paths))


def forecast_bands(spark, sf):
    rmse = metrics(spark, sf).where(F.col("model") == "naive_lag1")
    return fc.bands(path_rows(spark, sf), rmse)


def candidate_gate(spark, sf):
    m = metrics(spark, sf).groupBy("crop").agg(
        F.max(F.when(F.col("model") == "moving_average_7", F.col("mae"))).alias("candidate_mae"),
        F.max(F.when(F.col("model") == "moving_average_30", F.col("mae"))).alias("production_mae"))
    return fc.candidate_gate(path_rows(spark, sf), m)


def price_decisions(spark, sf):
    return decisions(spark, sf)


def decision_reasons(spark, sf):
    """Reasons of the advisory action and the storage decision, with the climate of the forecast's last month."""
    d = decisions(spark, sf).withColumn("year", F.year(F.date_add(_cut(), 29)).cast("bigint")).withColumn("month", F.month(F.date_add(_cut(), 29)).cast("bigint"))
    r = fc.decision_reasons(ft.climate_lookup(d, T.climate_history(spark, sf)), X.lookup(F.col("crop"), {t.lower(): n for t, n in T.TYPE_CROPS.items()}))
    return r.withColumn("reasons", F.array_join("reasons", " | "))


def decision_breakdown(spark, sf):
    return fc.decision_breakdown(decisions(spark, sf))


def identical_forecasts(spark, sf):
    """Forecasts rounded to hundreds, so that groups of equal ones exist."""
    d = decisions(spark, sf).withColumn("predicted_price", N.round_to(F.col("predicted_price") / F.lit(100.0), 0) * F.lit(100.0))
    return fc.identical_forecasts(d)


def state_specificity(spark, sf):
    return fc.state_specificity(decisions(spark, sf))


def extreme_forecasts(spark, sf):
    return fc.extreme_forecasts(decisions(spark, sf), 40.0)


def forecast_spikes(spark, sf):
    return fc.forecast_spikes(path_rows(spark, sf))


def decision_compliance(spark, sf):
    return fc.decision_compliance(decisions(spark, sf), WIDE)


def forecast_grid(spark, sf):
    return fc.forecast_grid(decisions(spark, sf), [t.lower() for t in T.TYPE_CROPS])


def quality_matrix(spark, sf):
    return fc.quality_matrix(PR.coverage_grid(spark, sf), horizon_metrics(spark, sf))


def forecast_confidence(spark, sf):
    m = metrics(spark, sf).where(F.col("model") == "naive_lag1").select("crop", "mae")
    mean = prices.coverage_by_series(daily(spark, sf)).select("crop", "state", "avg_price")
    o = outlook(spark, sf).join(m, "crop").join(mean, ["crop", "state"])
    h = T.pick(F.dayofmonth("observation_date") % 5, [7, 15, 30, 60, 90])
    o = o.withColumn("horizon", h.cast("bigint"))
    return o.select("crop", "state", "horizon", "data_age_days", *[
        v.alias(k) for k, v in R.forecast_confidence(F.col("mae"), F.col("avg_price"), F.col("horizon"), F.col("data_age_days")).items()])


def price_texts(spark, sf):
    t = fc.price_texts(decisions(spark, sf).withColumn("market", F.concat("state", F.lit(" Mandi"))))
    return t.select("crop", "state", "recommendation", "analysis", X.has_forbidden(F.col("analysis")).alias("forbidden"))


def public_results(spark, sf):
    d = decisions(spark, sf).withColumn("market_name", F.concat("state", F.lit(" Mandi"))).withColumn("horizon_days", F.lit(30).cast("bigint"))
    return fc.public_view(d)


QUERIES = {f.__name__: f for f in [
    baseline_metrics, best_model, model_comparison, recursive_forecast, horizon_metrics, forecast_summary, trend_statistics, forecast_bands,
    candidate_gate, price_decisions, decision_reasons, decision_breakdown, identical_forecasts, state_specificity, extreme_forecasts, forecast_spikes, decision_compliance,
    forecast_grid, quality_matrix, forecast_confidence, price_texts, public_results]}

# ------------------------------------------------------------------ check SQL
D = "CAST({} AS DOUBLE)".format


def _metrics(rows: str, by: str) -> str:
    return f"""SELECT {by}, n AS row_count, {S.rnd('e1 / n / ' + D(1e6), 2)} AS mae, {S.rnd('sqrt(e2 / n / ' + D(1e12) + ')', 2)} AS rmse, {S.rnd('ratio / n / ' + D(1e7), 2)} AS mape,
 {S.rnd(D(1) + ' - e2 / n / ' + D(1e12) + ' / nullif(spread / (CAST(n AS DOUBLE) * n) / ' + D(1e4) + ', 0)', 4)} AS r2 FROM (
 SELECT {by}, count(*) AS n, CAST(sum(e) AS DOUBLE) AS e1, CAST(sum(e * e) AS DOUBLE) AS e2, CAST(sum({S.whole('e / CAST(greatest(y_m, 1000000) AS DOUBLE) * ' + D(1e9))}) AS DOUBLE) AS ratio,
  CAST(sum(y_c * y_c) * count(*) - sum(y_c) * sum(y_c) AS DOUBLE) AS spread FROM (
  SELECT {by}, y_m, CAST(y_c AS HUGEINT) AS y_c, CAST(abs(y_m - p_m) AS HUGEINT) AS e FROM (
   SELECT {by}, {S.whole('y * ' + D(1e6))} AS y_m, {S.whole('yhat * ' + D(1e6))} AS p_m, {S.whole('y * ' + D(100))} AS y_c FROM {rows} WHERE yhat IS NOT NULL)) GROUP BY ALL)"""


HOLD = PF.FEATURES + f""", hold AS (SELECT * FROM feats WHERE ds >= DATE '{T.SPLIT_DATE}'),
preds AS ({' UNION ALL '.join(f"SELECT crop, '{m}' AS model, y, {c} AS yhat FROM hold" for m, c in MODELS.items())}),
metrics AS ({_metrics('preds', 'crop, model')})"""
_K = len(fc.LINEAR_TERMS)
_V = [*fc.LINEAR_TERMS, "y"]
_EXACT = "CAST(CAST({} AS VARCHAR) AS DOUBLE)".format  # a whole number of any length to the nearest double


def _spread(i: int, j: int) -> str:
    q = f"q_{min(i, j)}_{max(i, j)}"
    return f"{_EXACT(f'n * {q} - s_{i} * s_{j}')} / CAST(n AS DOUBLE) / {D(1e6)} + {D(1.0 if i == j else 0.0)}"


#: Moments, elimination step by step, and ``beta`` (crop, intercept, c); after FEATURES or HOLD.
RIDGE = f"""rscaled AS (SELECT crop, {', '.join(f"CAST({S.whole(f'{c} * ' + D(1000))} AS HUGEINT) AS v_{i}" for i, c in enumerate(_V))} FROM feats WHERE ds < DATE '{T.SPLIT_DATE}'),
rsums AS (SELECT crop, CAST(count(*) AS HUGEINT) AS n, {', '.join(f'CAST(sum(v_{i}) AS HUGEINT) AS s_{i}' for i in range(_K + 1))},
 {', '.join(f'CAST(sum(v_{i} * v_{j}) AS HUGEINT) AS q_{i}_{j}' for i in range(_K + 1) for j in range(i, _K + 1))} FROM rscaled GROUP BY 1),
rmat AS (SELECT crop, [{', '.join(f"{_EXACT(f's_{i}')} / CAST(n AS DOUBLE) / {D(1000)}" for i in range(_K + 1))}] AS means,
 [{', '.join('[' + ', '.join(_spread(i, j) for j in range(_K + 1)) + ']' for i in range(_K))}] AS m FROM rsums),
elim AS (SELECT crop, means, 1 AS p, m FROM rmat UNION ALL
 SELECT crop, means, p + 1, list_transform(m, lambda r, i: CASE WHEN i = p THEN list_transform(r, lambda x: x / r[p]) ELSE list_transform(r, lambda x, j: x - r[p] * (m[p][j] / m[p][p])) END) FROM elim WHERE p <= {_K}),
beta AS (SELECT crop, means[{_K + 1}]{''.join(f' - m[{i + 1}][{_K + 1}] * means[{i + 1}]' for i in range(_K))} AS intercept, list_transform(m, lambda r: r[{_K + 1}]) AS c FROM elim WHERE p = {_K + 1})"""
TERMS = " + ".join(f"c[{i + 1}] * {t}" for i, t in enumerate(fc.LINEAR_TERMS))
FITTED = PF.FEATURES.replace("quote_lines AS", "RECURSIVE quote_lines AS", 1) + ", " + RIDGE
_C = [D(c) for c in COEFFICIENTS]
PATHS = f"""pre AS (SELECT * FROM daily WHERE ds < DATE '{T.SPLIT_DATE}'),
tails AS (SELECT crop, state, list({S.rs('y_cents')} ORDER BY ds) AS p FROM (SELECT *, row_number() OVER (PARTITION BY crop, state ORDER BY ds DESC) AS b FROM pre) WHERE b <= 60 GROUP BY 1, 2),
lives AS (SELECT crop, state, {S.rs('max(modal_cents)')} AS live FROM (SELECT *, rank() OVER (PARTITION BY crop, state ORDER BY ds DESC) AS r FROM quotes WHERE ds < DATE '{T.SPLIT_DATE}') WHERE r = 1 GROUP BY 1, 2),
seeds AS (SELECT t.crop, t.state, CASE WHEN len(p) >= 15 THEN list_concat(list_transform(range(greatest(30 - len(p), 0)), lambda i: p[1]), list_append(p[:len(p) - 1], live))
  ELSE list_transform(range(30), lambda i: live) END AS acc FROM tails t JOIN lives l ON l.crop = t.crop AND l.state = t.state),
walk AS (SELECT s.crop, s.state, 0 AS step, acc, intercept, c FROM seeds s LEFT JOIN beta b ON b.crop = s.crop UNION ALL
 SELECT crop, state, step + 1, list_append(acc, intercept + c[1] * acc[-1] + c[2] * acc[-7] + c[3] * acc[-14] + c[4] * acc[-30]
  + c[5] * (list_sum(acc[-7:]) / {D(7)}) + c[6] * (list_sum(acc[-30:]) / {D(30)})), intercept, c FROM walk WHERE step < 30),
fcast AS (SELECT crop, state, CAST(step AS BIGINT) AS step, DATE '{T.SPLIT_DATE}' + CAST(step - 1 AS INTEGER) AS ds, {S.rnd('acc[-1]', 2)} AS yhat FROM walk WHERE step > 0),
bt_rows AS (SELECT crop, state, ds, y_cents, row_number() OVER w AS rn, lag(ds) OVER w AS before FROM daily WINDOW w AS (PARTITION BY crop, state ORDER BY ds)),
bt_at AS (SELECT crop, state, rn, CAST(date_trunc('month', ds) AS DATE) AS origin FROM bt_rows WHERE rn > 15 AND date_trunc('month', ds) <> date_trunc('month', before)),
bt_seeds AS (SELECT a.crop, a.state, a.origin, list({S.rs('y_cents')} ORDER BY r.rn) AS p FROM bt_at a JOIN bt_rows r ON r.crop = a.crop AND r.state = a.state AND r.rn BETWEEN a.rn - 30 AND a.rn - 1 GROUP BY ALL),
bt_walk AS (SELECT crop, state, origin, 0 AS step, list_concat(list_transform(range(30 - len(p)), lambda i: p[1]), p) AS acc FROM bt_seeds UNION ALL
 SELECT crop, state, origin, step + 1, list_append(acc, {D(INTERCEPT)} + {_C[0]} * acc[-1] + {_C[1]} * acc[-7] + {_C[2]} * acc[-14] + {_C[3]} * acc[-30]
  + {_C[4]} * (list_sum(acc[-7:]) / {D(7)}) + {_C[5]} * (list_sum(acc[-30:]) / {D(30)})) FROM bt_walk WHERE step < 30),
hm0 AS (SELECT w.crop, CAST(step AS BIGINT) AS horizon, {S.rs('y_cents')} AS y, {S.rnd('acc[-1]', 2)} AS yhat FROM bt_walk w JOIN daily d ON d.crop = w.crop AND d.state = w.state AND d.ds = w.origin + CAST(step - 1 AS INTEGER) WHERE step IN (1, 7, 15, 30)),
hm AS (SELECT *, CASE WHEN mape < 7 THEN 'HIGH' WHEN mape < 15 THEN 'MODERATE' ELSE 'UNCERTAIN' END AS reliability_rating FROM ({_metrics('hm0', 'crop, horizon')}))"""
_PT = "CAST(floor({} + 0.5) AS BIGINT)".format
PATH_ROWS = f"""{FITTED}, {PATHS}, pr AS (SELECT crop, state, step, ds, yhat FROM fcast)"""
HOLD_FITTED = HOLD.replace("quote_lines AS", "RECURSIVE quote_lines AS", 1) + ", " + RIDGE
HOLD_PATHS = PATH_ROWS.replace(FITTED, HOLD_FITTED)
_EVENT = "CASE " + " ".join(f"WHEN DATE '{T.SPLIT_DATE}' + 29 BETWEEN DATE '{a}' AND DATE '{b}' THEN '{n}'" for n, a, b, _ in T.FIXTURE_DISRUPTIONS) + " END"
_WIDE = "(" + ", ".join(f"'{c}'" for c in WIDE) + ")"
OUTLOOK = PATH_ROWS + f""", last AS (SELECT crop, state, max(ds) AS last_ds, CAST(sum(market_count) AS BIGINT) AS record_count FROM pre GROUP BY 1, 2),
ol AS (SELECT s.crop, s.state, {S.rnd('s.acc[-1]', 2)} AS current_price, f.yhat AS predicted_price, last_ds AS observation_date, date_diff('day', last_ds, DATE '{T.SPLIT_DATE}') AS data_age_days,
 {_EVENT} IS NOT NULL AS disrupted, CAST({_EVENT} AS VARCHAR) AS event, coalesce(f.yhat > 0, FALSE) AS available,
 CASE WHEN record_count >= 200 THEN 'STATE_CROP' WHEN record_count >= 50 THEN 'STATE_AWARE' ELSE 'CROP_ONLY' END AS forecast_scope
 FROM seeds s JOIN fcast f ON f.crop = s.crop AND f.state = s.state AND f.step = 30 JOIN last l ON l.crop = s.crop AND l.state = s.state),
d0 AS (SELECT *, {S.rnd('(predicted_price - current_price) / current_price * ' + D(100), 2)} AS change_percent, (predicted_price - current_price) / current_price * {D(100)} AS ch FROM ol),
d1 AS (SELECT *, CASE WHEN data_age_days > 14 THEN 'WAIT' WHEN abs(change_percent) < CASE WHEN crop IN {_WIDE} THEN 5 ELSE 3 END THEN 'WAIT' WHEN change_percent < 0 THEN 'SELL' ELSE 'HOLD' END AS plain FROM d0),
decs0 AS (SELECT crop, state, current_price, predicted_price, observation_date, data_age_days, disrupted, event, available, forecast_scope, change_percent,
 CASE WHEN available THEN CASE WHEN plain = 'HOLD' AND disrupted AND change_percent < 8 THEN 'WAIT' ELSE plain END END AS recommendation, CASE WHEN available THEN plain END AS plain_recommendation,
 CASE WHEN available THEN CASE WHEN ch <= -3 THEN 'SELL' WHEN ch >= 3 THEN 'HOLD' ELSE 'WAIT' END END AS advisory_action,
 CASE WHEN change_percent > 5 THEN 'HOLD' ELSE 'SELL' END AS storage_decision, {S.rnd('change_percent - ' + D(2), 2)} AS net_gain_percent FROM d1),
decs AS (SELECT *, CASE WHEN recommendation IS NULL THEN NULL WHEN data_age_days > 14 THEN 'The latest Mandi price observation is ' || data_age_days || ' days old. Market conditions may have changed. Verify current local Mandi rates before making a transaction decision.'
 WHEN recommendation = 'WAIT' AND plain_recommendation = 'HOLD' THEN 'An active market disruption (' || event || ') introduces significant price uncertainty. Verify local conditions before acting.'
 WHEN recommendation = 'WAIT' THEN 'The 30-day forecast indicates a marginal movement of ' || printf('%+.1f', {S.rnd('change_percent', 1)}) || '% — within model uncertainty bounds. Prices are expected to remain relatively stable.'
 WHEN recommendation = 'SELL' THEN 'The 30-day forecast indicates a price decline of approximately ' || printf('%.1f', abs({S.rnd('change_percent', 1)})) || '% from Rs.' || format('{{:,}}', {_PT('current_price')}) || ' to Rs.' || format('{{:,}}', {_PT('predicted_price')}) || '. Selling at the current observed Mandi price may reduce downside risk.'
 ELSE 'The 30-day forecast indicates a price increase of approximately ' || printf('%.1f', {S.rnd('change_percent', 1)}) || '% from Rs.' || format('{{:,}}', {_PT('current_price')}) || ' to Rs.' || format('{{:,}}', {_PT('predicted_price')}) || '. Holding may provide a better expected selling price.' END AS recommendation_reason FROM decs0)"""
_MEAN = lambda k: S.rnd(f"CAST(CAST(sum({S.whole('yhat * 100.0')}) FILTER (step <= {k}) AS BIGINT) AS DOUBLE) / count(*) FILTER (step <= {k}) / {D(100)}", 2)
_HF = f"CASE WHEN horizon <= 7 THEN {D(1)} WHEN horizon <= 15 THEN {D(0.95)} WHEN horizon <= 30 THEN {D(0.9)} WHEN horizon <= 60 THEN {D(0.8)} ELSE {D(0.7)} END"
_AF = f"CASE WHEN data_age_days < 1 THEN {D(1)} WHEN data_age_days <= 3 THEN {D(0.95)} WHEN data_age_days <= 7 THEN {D(0.85)} ELSE {D(0.7)} END"

def _text(parts, *values) -> str:
    return " || ".join([x for pair in zip(map(S.lit, parts), values) for x in pair] + [S.lit(x) for x in parts[len(values):]])


_p1, _s1 = (lambda e: f"printf('%.1f', {S.rnd(e, 1)})"), (lambda e: f"printf('%+.1f', {S.rnd(e, 1)})")
_TITLE = S.case_map("crop", {t.lower(): n for t, n in T.TYPE_CROPS.items()})
_REASONS = f"""WITH {OUTLOOK}, {PF._LEVELS}, x AS (SELECT *, {_TITLE} AS title, CAST(year(DATE '{T.SPLIT_DATE}' + 29) AS BIGINT) AS year, CAST(month(DATE '{T.SPLIT_DATE}' + 29) AS BIGINT) AS month,
  abs((predicted_price - current_price) / current_price * {D(100)}) AS moved, change_percent AS cp, net_gain_percent AS ng FROM decs), y AS (SELECT x.*, {PF._CLIMATE_COLS} FROM x {PF._CLIMATE_JOIN})
 SELECT crop, state, advisory_action, CASE WHEN NOT available THEN {S.lit(fc.ADVICE_NONE)} WHEN advisory_action IS NULL THEN {S.lit(fc.ADVICE_NO_PRICE)} WHEN advisory_action = 'SELL' THEN {_text(fc.ADVICE_DOWN, _p1('moved'))}
  WHEN advisory_action = 'HOLD' THEN {_text(fc.ADVICE_UP, _p1('moved'))} ELSE {_text(fc.ADVICE_FLAT, _p1('moved'))} END AS advisory_reason, storage_decision,
 CASE WHEN NOT available OR cp IS NULL THEN NULL WHEN cp > 5 THEN {_text(fc.STORAGE_UP, _s1('cp'), "'2.0'")} WHEN cp < -5 THEN {_text(fc.STORAGE_DOWN, _p1('cp'))} ELSE {_text(fc.STORAGE_FLAT, _s1('cp'), "'2.0'")} END AS storage_reason,
 CASE WHEN available AND cp IS NOT NULL THEN array_to_string([CASE WHEN cp > 2 THEN {_text(fc.TREND_UP, _p1('cp'))} WHEN cp < -2 THEN {_text(fc.TREND_DOWN, _p1('cp'))} ELSE {_text(fc.TREND_FLAT, _s1('cp'))} END,
  CASE WHEN storage_decision = 'HOLD' THEN {_text(fc.GAIN_HOLD, "'2.0'", _p1('ng'))} ELSE {_text(fc.GAIN_SELL, "'2.0'", _s1('ng'))} END,
  title || CASE {' '.join(f"WHEN title IN ({', '.join(map(S.lit, c))}) THEN {S.lit(t)}" for c, t in reversed(fc.SEASON_TEXTS.items()))} ELSE {S.lit(fc.SEASON_OTHER)} END,
  {_text(fc.CLIMATE_TEXT, _p1('avg_temp'), _p1('total_rainfall'))}], ' | ') END AS reasons FROM y"""

ORACLES = {
    "baseline_metrics": f"WITH {HOLD} SELECT * FROM metrics",
    "best_model": f"""WITH {HOLD}, o AS (SELECT crop, model, mae, row_number() OVER (PARTITION BY crop ORDER BY mae, model) AS rn FROM metrics WHERE model <> 'naive_lag1'),
 p AS (SELECT crop, mae FROM metrics WHERE model = 'naive_lag1') SELECT o.crop, CASE WHEN p.mae < o.mae THEN 'naive_lag1' ELSE o.model END AS best_model, least(p.mae, o.mae) AS best_mae FROM o JOIN p ON p.crop = o.crop WHERE rn = 1""",
    "model_comparison": f"WITH {HOLD} SELECT *, row_number() OVER (PARTITION BY crop ORDER BY mae, model) = 1 AS is_best FROM metrics",
    "recursive_forecast": f"WITH {FITTED}, {PATHS} SELECT * FROM fcast",
    "horizon_metrics": f"WITH {FITTED}, {PATHS} SELECT * FROM hm",
    "forecast_summary": f"""WITH {PATH_ROWS}, long AS (SELECT s.crop, s.state, 0 AS step, acc, intercept, c FROM seeds s LEFT JOIN beta b ON b.crop = s.crop UNION ALL
 SELECT crop, state, step + 1, list_append(acc, greatest(intercept + c[1] * acc[-1] + c[2] * acc[-7] + c[3] * acc[-14] + c[4] * acc[-30]
  + c[5] * (list_sum(acc[-7:]) / {D(7)}) + c[6] * (list_sum(acc[-30:]) / {D(30)}), {D(100)})), intercept, c FROM long WHERE step < 90),
 p90 AS (SELECT crop, state, CAST(step AS BIGINT) AS step, {S.rnd('acc[-1]', 2)} AS yhat FROM long WHERE step > 0) SELECT crop, state, min_by(yhat, step) AS starting_price, max_by(yhat, step) FILTER (step <= 30) AS ending_price, max(yhat) FILTER (step <= 30) AS highest_price, min(yhat) FILTER (step <= 30) AS lowest_price,
 {_MEAN(30)} AS average_price, {', '.join(f'{_MEAN(h)} AS mean_{h}_day' for h in (7, 15, 30, 60, 90))} FROM p90 GROUP BY 1, 2""",
    "trend_statistics": f"""WITH {OUTLOOK}, mv AS (SELECT *, abs(yhat - lag(yhat) OVER (PARTITION BY crop, state ORDER BY step)) AS move FROM pr),
 g AS (SELECT crop, state, avg(yhat) AS m, min(yhat) AS lo, max(yhat) AS hi, stddev_pop(yhat) AS sd, var_pop(yhat) AS v, regr_slope(yhat, {D('step')}) AS sl, avg(move) AS mo FROM mv GROUP BY 1, 2),
 j AS (SELECT g.*, (m - current_price) / current_price * {D(100)} AS ch, sl / current_price * {D(100)} AS sp FROM g JOIN ol ON ol.crop = g.crop AND ol.state = g.state)
 SELECT crop, state, {S.rnd('ch', 2)} AS expected_change_percent, {S.rnd('m', 2)} AS average_price, {S.rnd('lo', 2)} AS minimum_price, {S.rnd('hi', 2)} AS maximum_price, {S.rnd('sl', 2)} AS forecast_slope,
 {S.rnd('mo', 2)} AS daily_average_change, {S.rnd('sd', 2)} AS forecast_std, {S.rnd('v', 2)} AS forecast_variance, {S.rnd('sd / m * ' + D(100), 2)} AS volatility_percent,
 CASE WHEN ch > 2 THEN 'UPWARD' WHEN ch < -2 THEN 'DOWNWARD' ELSE 'STABLE' END AS trend_direction,
 CASE WHEN abs(ch) >= 8 OR abs(sp) >= 0.25 THEN 'HIGH' WHEN abs(ch) >= 3 OR abs(sp) >= 0.08 THEN 'MEDIUM' ELSE 'LOW' END AS trend_strength FROM j""",
    "forecast_bands": f"""WITH {HOLD_PATHS}, ln AS (SELECT crop, state, regr_slope(yhat, {D('step')}) AS a, regr_intercept(yhat, {D('step')}) AS b FROM pr GROUP BY 1, 2),
 j AS (SELECT pr.*, a, b, CASE WHEN rmse > 0 THEN rmse * {D(1.2)} ELSE {D(50)} END AS margin FROM pr JOIN ln ON ln.crop = pr.crop AND ln.state = pr.state LEFT JOIN metrics m ON m.crop = pr.crop AND m.model = 'naive_lag1')
 SELECT crop, state, step, yhat, {S.rnd('greatest(yhat - margin, ' + D(50) + ')', 2)} AS lower_bound, {S.rnd('yhat + margin', 2)} AS upper_bound, {S.rnd('a * step + b', 2)} AS trend_line FROM j""",
    "candidate_gate": f"""WITH {HOLD_PATHS},
 ps AS (SELECT crop, state, count(*) AS n, min(yhat) AS lo, max(yhat) AS hi, min_by(yhat, step) AS f FROM pr GROUP BY 1, 2),
 pc AS (SELECT crop, bool_and(n = 30) AS c, bool_and(lo > 0) AS p, bool_and(hi <= f * {D(3.5)}) AS k FROM ps GROUP BY 1),
 m AS (SELECT crop, max(mae) FILTER (model = 'moving_average_7') AS candidate_mae, max(mae) FILTER (model = 'moving_average_30') AS production_mae FROM metrics GROUP BY 1),
 r AS (SELECT m.*, CASE WHEN NOT coalesce(c, FALSE) THEN 'FORECAST_INCOMPLETE' WHEN NOT p THEN 'NON_POSITIVE_PRICE' WHEN NOT k THEN 'EXTREME_SPIKE' WHEN candidate_mae > production_mae * {D(1.1)} THEN 'WORSE_THAN_PRODUCTION' ELSE 'PASSED' END AS reason FROM m LEFT JOIN pc ON pc.crop = m.crop)
 SELECT crop, CASE WHEN reason = 'PASSED' THEN 'PROMOTE' ELSE 'REJECT' END AS decision, reason, candidate_mae, production_mae FROM r""",
    "price_decisions": f"WITH {OUTLOOK} SELECT * FROM decs",
    "decision_reasons": _REASONS,
    "decision_breakdown": f"""WITH {OUTLOOK} SELECT crop, count(*) AS total, count(*) FILTER (recommendation = 'SELL') AS sell, count(*) FILTER (recommendation = 'HOLD') AS hold, count(*) FILTER (recommendation = 'WAIT') AS wait,
 count(*) FILTER (forecast_scope = 'STATE_CROP') AS state_crop, count(*) FILTER (forecast_scope <> 'STATE_CROP') AS fallback FROM decs GROUP BY 1""",
    "identical_forecasts": f"""WITH {OUTLOOK} SELECT crop, {S.rnd(S.rnd('predicted_price / ' + D(100), 0) + ' * ' + D(100), 1)} AS price, count(*) AS state_count, string_agg(state, ',' ORDER BY state) AS states,
 bool_and(forecast_scope = 'CROP_ONLY') AS acceptable FROM decs GROUP BY 1, 2 HAVING count(*) > 1""",
    "state_specificity": f"""WITH {OUTLOOK}, g AS (SELECT crop, count(*) AS total_predictions, count(DISTINCT {S.rnd('predicted_price', 0)}) AS unique_rounded_values, min(predicted_price) AS min_predicted, max(predicted_price) AS max_predicted FROM decs GROUP BY 1)
 SELECT *, {S.rnd('unique_rounded_values * ' + D(100) + ' / total_predictions', 1)} AS pct_state_specific, {S.rnd('max_predicted - min_predicted', 2)} AS state_price_range FROM g""",
    "extreme_forecasts": f"WITH {OUTLOOK} SELECT crop, state, current_price, predicted_price, change_percent FROM decs WHERE abs(change_percent) > 40",
    "forecast_spikes": f"WITH {PATH_ROWS}, g AS (SELECT crop, state, min_by(yhat, step) AS first_price, max(yhat) AS highest_price, min(yhat) AS lowest_price FROM pr GROUP BY 1, 2) SELECT *, highest_price > first_price * {D(3.5)} AS spike, lowest_price <= 0 AS not_positive FROM g",
    "decision_compliance": f"WITH {OUTLOOK} SELECT crop, count(*) AS checked, count(*) FILTER (recommendation IS DISTINCT FROM plain_recommendation) AS mismatches FROM decs GROUP BY 1",
    "forecast_grid": f"WITH {OUTLOOK} SELECT state, " + ", ".join(f"max(recommendation) FILTER (crop = '{t.lower()}') AS {t.lower()}" for t in T.TYPE_CROPS) + " FROM decs GROUP BY 1",
    "quality_matrix": f"""WITH {FITTED}, {PATHS}, {PR.GRID} SELECT g.state, g.crop, record_count, CASE WHEN record_count >= 200 THEN 'STATE_CROP_MODEL' WHEN record_count >= 50 THEN 'STATE_AWARE_FALLBACK' ELSE 'CROP_LEVEL_FALLBACK' END AS forecast_tier,
 CASE WHEN record_count >= 200 THEN 'HIGH' WHEN record_count >= 50 THEN 'MODERATE' ELSE 'LOW_PROVABLY_NATIONAL' END AS confidence_level, mape AS estimated_mape FROM graded g LEFT JOIN hm ON hm.crop = g.crop AND horizon = 30""",
    "forecast_confidence": f"""WITH {OUTLOOK.replace(FITTED, HOLD_FITTED)}, av AS (SELECT crop, state, {S.rnd('CAST(CAST(sum(y_cents) AS BIGINT) AS DOUBLE) / count(*) / 100.0', 2)} AS mp FROM daily GROUP BY 1, 2),
 j AS (SELECT ol.crop, ol.state, CAST({S.pick('day(observation_date) % 5', [7, 15, 30, 60, 90])} AS BIGINT) AS horizon, data_age_days, mae, mp FROM ol JOIN metrics m ON m.crop = ol.crop AND model = 'naive_lag1' JOIN av ON av.crop = ol.crop AND av.state = ol.state),
 b AS (SELECT *, greatest({D(1)} - least(mae / mp, {D(0.5)}), {D(0.5)}) AS base, {_HF} AS hf, {_AF} AS af FROM j), s AS (SELECT *, greatest({D(0.4)}, least({D(0.95)}, base * hf * af)) AS sc FROM b)
 SELECT crop, state, horizon, data_age_days, {S.rnd('sc', 4)} AS confidence_score, {S.rnd('sc * ' + D(100), 1)} AS confidence_pct, {S.whole('base * ' + D(100))} AS model_quality, {S.whole('hf * ' + D(100))} AS horizon_penalty, {S.whole('af * ' + D(100))} AS data_freshness FROM s""",
    "price_texts": f"""WITH {OUTLOOK}, t AS (SELECT crop, state, recommendation, 'Mandi price at ' || state || ' Mandi was Rs.' || format('{{:,}}', {_PT('current_price')}) || '/quintal (' || strftime(observation_date, '%d-%m-%Y') || '). ' AS head,
 {S.rnd('change_percent', 1)} AS c1, format('{{:,}}', {_PT('predicted_price')}) AS pp FROM decs),
 u AS (SELECT crop, state, recommendation, CASE recommendation WHEN 'SELL' THEN head || 'The 30-day forecast projects a price decline of ' || printf('%.1f', abs(c1)) || '% to Rs.' || pp || '/quintal. Selling now minimizes downside price risk.'
 WHEN 'HOLD' THEN head || 'The 30-day forecast projects price appreciation of ' || printf('%+.1f', c1) || '% to Rs.' || pp || '/quintal. Holding may capture higher value.'
 WHEN 'WAIT' THEN head || 'The 30-day forecast projects stable prices around Rs.' || pp || '/quintal (' || printf('%+.1f', c1) || '% change).'
 ELSE 'A reliable 30-day price forecast is currently unavailable for this crop.' END AS analysis FROM t)
 SELECT *, regexp_matches(analysis, '[0-9]+([.][0-9]+)?/[0-9]+|MAE|RMSE|STATE_CROP|CROP_ONLY|STATE_AWARE') AS forbidden FROM u""",
    "public_results": f"WITH {OUTLOOK} SELECT available, crop, state, current_price, predicted_price, CAST(30 AS BIGINT) AS horizon_days, observation_date, state || ' Mandi' AS market_name, data_age_days, recommendation, recommendation_reason FROM decs",
}
