"""Feature invariants and agreement with pandas."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from furrow.operators import features as ft
from furrow.operators import prices
from furrow.operators.prices import exact_quantiles
from furrow.plans import prices as P


def series(spark, n=60, bump=None, crop="rice", state="Goa"):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(n):
        y = 200000 + int(rng.integers(0, 50000))
        if bump is not None and i >= bump:
            y += 999999
        rows.append((dt.date(2020, 1, 1) + dt.timedelta(days=2 * i), crop, state, y, y - 100, y + 200, 1, 300))
    return spark.createDataFrame(rows, "ds date, crop string, state string, y_cents bigint, min_cents bigint, max_cents bigint, market_count bigint, range_cents bigint")


def test_features_match_pandas(spark):
    d = series(spark)
    got = ft.lag_features(d, [("2020-02-01", "2020-02-29")]).orderBy("ds").toPandas()
    p = d.toPandas().sort_values("ds").reset_index(drop=True)
    y = p["y_cents"] / 100.0
    want = pd.DataFrame({"lag_1": y.shift(1), "lag_30": y.shift(30), "rolling_7": y.shift(1).rolling(7, min_periods=1).mean(),
                         "rolling_30": y.shift(1).rolling(30, min_periods=1).mean(), "rolling_std_7": y.shift(1).rolling(7, min_periods=2).std().fillna(0.0)})
    want = want.dropna().reset_index(drop=True)
    assert len(got) == 30
    for c in want.columns:
        np.testing.assert_allclose(got[c], want[c], rtol=1e-9)
    stamps = pd.to_datetime(got["ds"])
    assert (got["day_of_week"] == stamps.dt.dayofweek).all() and (got["day_of_year"] == stamps.dt.dayofyear).all()
    assert (got["black_swan"] == ((stamps >= "2020-02-01") & (stamps <= "2020-02-29")).astype(int)).all()


def test_future_prices_never_reach_a_feature(spark):
    base = ft.lag_features(series(spark), []).drop("y", "price_range").toPandas().sort_values("ds").reset_index(drop=True)
    changed = ft.lag_features(series(spark, bump=45), []).drop("y", "price_range").toPandas().sort_values("ds").reset_index(drop=True)
    upto = base["ds"] <= dt.date(2020, 1, 1) + dt.timedelta(days=2 * 45)
    pd.testing.assert_frame_equal(base[upto], changed[upto])
    assert not base[~upto].equals(changed[~upto])


def test_current_row_mean_is_leaky_only_on_request(spark):
    climate = spark.createDataFrame([(2019, 1, 20.0, 5.0)], "year bigint, month bigint, avg_temp double, total_rainfall double")
    d = series(spark)
    safe = ft.cascade_features(d, climate, []).orderBy("ds").first()
    leaky = ft.cascade_features(d, climate, [], include_current=True).orderBy("ds").first()
    y = [r["y_cents"] / 100 for r in d.orderBy("ds").collect()]
    assert abs(safe["rolling_mean_7"] - np.mean(y[23:30])) < 0.006
    assert abs(leaky["rolling_mean_7"] - np.mean(y[24:31])) < 0.006
    assert (safe["monthly_avg_temp"], safe["monthly_total_rainfall"]) == (20.0, 5.0)


def test_short_series_are_gated(spark):
    assert ft.lag_features(series(spark, n=14), [], need_lags=False).count() == 0
    assert ft.lag_features(series(spark, n=15), [], need_lags=False).count() == 15


def test_state_codes_equal_the_feature_states(spark, sf):
    d = P.daily(spark, sf)
    f = ft.lag_features(d, [])
    want = f.select("crop", "state").distinct().toPandas().sort_values(["crop", "state"])
    want["state_enc"] = want.groupby("crop").cumcount()
    got = ft.state_codes(d).toPandas().sort_values(["crop", "state"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want.reset_index(drop=True), check_dtype=False)


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(3)
    values = rng.integers(0, 50, 1000)
    df = spark.createDataFrame([("a" if i % 3 else "b", int(v)) for i, v in enumerate(values)], "g string, v bigint")
    got = {r["g"]: r for r in exact_quantiles(df, "g", "v", [0.1, 0.25, 0.5, 0.9]).collect()}
    for g in ("a", "b"):
        mine = [v for i, v in enumerate(values) if ("a" if i % 3 else "b") == g]
        for p in (10, 25, 50, 90):
            assert abs(got[g][f"q{p}"] - np.percentile(mine, p)) < 1e-9


def test_rollup_uses_positive_bounds_only(spark):
    rows = [(dt.date(2020, 1, 1), "rice", "Goa", 10000, 0, 12000), (dt.date(2020, 1, 1), "rice", "Goa", 10001, 9000, 0)]
    r = prices.daily_rollup(spark.createDataFrame(rows, "ds date, crop string, state string, modal_cents bigint, min_cents bigint, max_cents bigint")).first()
    assert (r["y_cents"], r["min_cents"], r["max_cents"], r["market_count"], r["range_cents"]) == (10001, 9000, 12000, 2, 3000)


def test_appending_twice_adds_nothing(spark, sf):
    q = P.increment(spark, sf)
    merged = prices.merge_series(P.history(spark, sf), q)
    assert prices.new_rows(merged, prices.daily_rollup(q)).count() == 0


def test_weekly_label_is_the_sunday(spark):
    rows = [(dt.date(2024, 1, d), "rice", "Goa", 100 * d) for d in (1, 7, 8)]
    got = {r["week_end"]: r["y"] for r in prices.weekly_mean(spark.createDataFrame(rows, "ds date, crop string, state string, y_cents bigint")).collect()}
    assert got == {dt.date(2024, 1, 7): 4.0, dt.date(2024, 1, 14): 8.0}


def test_entry_runs(spark):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    assert df.where(F.col("lag_30").isNull()).count() == 0 and "state_enc" in df.columns and df.count() > 0


def test_climate_falls_back_to_other_years(spark):
    climate = spark.createDataFrame([(2000, 1, 10.0, 5.0), (2001, 1, 20.0, 7.0), (2000, 2, 30.0, 9.0)], "year bigint, month bigint, avg_temp double, total_rainfall double")
    asked = spark.createDataFrame([(2001, 1), (1999, 1), (1999, 2), (1999, 3)], "year bigint, month bigint")
    got = {(r["year"], r["month"]): (r["avg_temp"], r["total_rainfall"]) for r in ft.climate_lookup(asked, climate).collect()}
    assert got[2001, 1] == (20.0, 7.0) and got[1999, 1] == (15.0, 6.0) and got[1999, 2] == (30.0, 9.0)
    assert got[1999, 3] == pytest.approx((20.0, 7.0))
