"""Models and paths against numpy and plain search, decisions against the stated rules."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.functions import boosting
from furrow.functions import scoring as R
from furrow.operators import advice as ad
from furrow.operators import features as ft
from furrow.operators import forecast as fc
from furrow.operators import models as md
from furrow.plans import features as PF
from furrow.plans import prices as P
from furrow.session import cut_lineage


@pytest.fixture(scope="module")
def encoded(spark, sf):
    return cut_lineage(ft.encoded_features(P.stored_daily(spark, sf), PF.SPANS))


def test_ridge_equals_numpy(spark, encoded):
    got = {r["crop"]: r for r in fc.ridge_by_crop(encoded, penalty=2.0).collect()}
    p = encoded.toPandas()
    for crop, g in p.groupby("crop"):
        x, y = g[fc.LINEAR_TERMS].to_numpy(), g["y"].to_numpy()
        xc, yc = x - x.mean(axis=0), y - y.mean()
        beta = np.linalg.solve(xc.T @ xc + 2.0 * np.eye(x.shape[1]), xc.T @ yc)
        np.testing.assert_allclose(got[crop]["coefficients"], beta, rtol=1e-5, atol=1e-7)
        assert got[crop]["intercept"] == pytest.approx(y.mean() - beta @ x.mean(axis=0), rel=1e-5)


def test_linear_path_equals_a_loop(spark):
    prices = [float(1000 + 7 * i % 130) for i in range(40)]
    coef = [0.4, 0.2, 0.1, 0.1, 0.1, 0.05]
    df = spark.createDataFrame([("rice", "Goa", prices, 12.0, coef)], "crop string, state string, prices array<double>, intercept double, coefficients array<double>")
    got = fc.recursive_linear(df, 90).first()["path"]
    h = list(prices)
    for _ in range(90):
        h.append(12.0 + np.dot(coef, [h[-1], h[-7], h[-14], h[-30], np.mean(h[-7:]), np.mean(h[-30:])]))
    assert len(got) == 90
    np.testing.assert_allclose(got, h[40:], rtol=1e-12)


def test_seeds_pad_replace_and_fall_back(spark):
    def tail(n):
        return [(dt.date(2020, 1, 1) + dt.timedelta(days=i), 100000 + i, 1, 2, 50) for i in range(n)]

    df = spark.createDataFrame([("a", "s", tail(20)), ("b", "s", tail(5)), ("c", "s", tail(60))],
                               "crop string, state string, tail array<struct<ds: date, y_cents: bigint, min_cents: bigint, max_cents: bigint, range_cents: bigint>>")
    live = spark.createDataFrame([("a", "s", 1234.5), ("b", "s", 777.0)], "crop string, state string, price double")
    got = {r["crop"]: r for r in fc.seed_prices(df, live).collect()}
    a = got["a"]["prices"]
    assert len(a) == 30 and a[:11] == [1000.0] * 11 and a[-1] == 1234.5 and a[-2] == 1000.18 and got["a"]["mean_range"] == 0.5
    assert got["b"]["prices"] == [777.0] * 30
    assert len(got["c"]["prices"]) == 60 and got["c"]["prices"][-1] == 1000.59


def test_path_has_exactly_the_horizon(spark):
    df = spark.createDataFrame([("rice", "Goa", [1.5] * 30)], "crop string, state string, path array<double>")
    rows = fc.dated_path(df, F.lit("2024-02-01").cast("date")).orderBy("step").collect()
    assert len(rows) == 30 and rows[0]["step"] == 1 and (rows[-1]["ds"] - rows[0]["ds"]).days == 29


def test_trees_by_exhaustive_search():
    """One round of depth one takes the split that plain search over all thresholds finds best."""
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 9, (80, 3)).astype(float), rng.normal(size=80)
    start, (tree,) = boosting.boost(x, y, rounds=1, depth=1, step=1.0)
    r = y - y.mean()
    gains = {}
    for f in range(3):
        for t in np.unique(x[:, f])[:-1] + 0.5:
            left = x[:, f] <= t
            gains[f, t] = r[left].sum() ** 2 / (left.sum() + 1) + r[~left].sum() ** 2 / ((~left).sum() + 1)
    best = max(gains, key=gains.get)
    assert (tree.feature[0], tree.threshold[0]) == best and start == pytest.approx(y.mean())
    left = x[:, best[0]] <= best[1]
    np.testing.assert_allclose(tree.predict(x), np.where(left, r[left].sum() / (left.sum() + 1), r[~left].sum() / ((~left).sum() + 1)))


def test_boosting_learns_and_rounds_are_prefixes():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 4))
    y = 5 * x[:, 0] + np.where(x[:, 1] > 0, 3.0, -3.0)
    start, trees = boosting.boost(x[:500], y[:500], 60, 4, 0.1, 0.8, 0.8)
    assert np.abs(boosting.predict(start, trees, x[500:]) - y[500:]).mean() < 0.3 * np.abs(y[500:] - y.mean()).mean()
    _, fewer = boosting.boost(x[:500], y[:500], 20, 4, 0.1, 0.8, 0.8)
    np.testing.assert_array_equal(boosting.predict(0.0, trees[:20], x), boosting.predict(0.0, fewer, x))
    assert boosting.boost(x[:0], y[:0], 5, 3, 0.1) == (0.0, [])


def test_tree_path_follows_the_fitted_trees(spark, encoded):
    one = encoded.where(F.col("crop") == "promo")
    nodes = md.fit_nodes(one, rounds=5, depth=4, step=0.3).toPandas()
    pdf = one.toPandas().sort_values(["ds", "state"])
    start, trees = boosting.boost(pdf[md.FEATURE_COLUMNS].to_numpy(float), pdf["y"].to_numpy(float), 5, 4, 0.3, md.SUBSAMPLE, md.COLUMN_SHARE)
    x = pdf[md.FEATURE_COLUMNS].to_numpy(float)
    np.testing.assert_allclose(boosting.predict(0.0, md._forest(nodes)["promo"], x), boosting.predict(start, trees, x))
    seeds = spark.createDataFrame([("promo", "NATION_1", 0, [900.0 + i for i in range(60)], 5.0), ("promo", "NATION_2", None, [1900.0] * 3, 5.0), ("other", "NATION_2", 1, [1900.0] * 30, 5.0)],
                                  "crop string, state string, state_enc bigint, prices array<double>, mean_range double")
    rows = {(r["crop"], r["state"]): r["path"] for r in md.tree_forecast(seeds, nodes, "2001-01-01", 30).collect()}
    assert len(rows) == 3 and all(len(p) == 30 and min(p) > 0 for p in rows.values())
    assert set(rows["promo", "NATION_2"]) == set(rows["other", "NATION_2"]) == {1900.0} and len(set(rows["promo", "NATION_1"])) > 1


def test_grid_search_flags_one_best(spark, encoded):
    some = encoded.where("crop in ('promo', 'small')")
    got = md.grid_search(some, "2001-01-01", {"depth": (2, 3), "step": (0.3,), "rounds": (2, 4)}, md.FEATURE_COLUMNS).collect()
    assert len(got) == 8 and sum(r["is_best"] for r in got) == 2
    for c in ("promo", "small"):
        mine = [r for r in got if r["crop"] == c]
        assert min(mine, key=lambda r: r["mae"])["is_best"]


def test_class_names_are_those_of_the_training_rows(spark):
    rows = [(i, "b" if i % 2 else "c", float(i % 2), float(i % 5)) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id bigint, label string, f0 double, f1 double")
    asked = df.union(spark.createDataFrame([(99, "a", 1.0, 2.0)], df.schema))
    got = md.class_probabilities(df, asked, ["f0", "f1"], "vec_id", trees=5, depth=3).collect()
    assert {r["candidate"] for r in got} == {"b", "c"}
    assert all(r["predicted"] == ("b" if r["vec_id"] == 99 or r["vec_id"] % 2 else "c") for r in got)
    sums = {}
    for r in got:
        sums[r["vec_id"]] = sums.get(r["vec_id"], 0) + r["probability"]
    assert all(v == pytest.approx(1.0) for v in sums.values()) and len(sums) == 61


def test_folds_are_even(spark):
    df = spark.createDataFrame([(i, "hot" if i % 10 else "rare") for i in range(1000)], "vec_id bigint, label string")
    n = {(r["label"], r["fold"]): r["count"] for r in md.stratified_folds(df).groupBy("label", "fold").count().collect()}
    assert set(n.values()) == {180, 20} and len(n) == 10


@pytest.mark.parametrize("crop,change,age,disrupted,want", [
    ("rice", -25.4, 0, False, "SELL"), ("rice", 41.2, 0, False, "HOLD"), ("rice", 2.9, 0, False, "WAIT"), ("rice", 41.2, 15, False, "WAIT"),
    ("onion", 4.0, 0, False, "WAIT"), ("onion", -5.0, None, False, "SELL"), ("rice", 7.0, 0, True, "WAIT"), ("rice", 8.0, 0, True, "HOLD")])
def test_outlook_rule(spark, crop, change, age, disrupted, want):
    c = R.outlook_decision(F.lit(crop), F.lit(change), F.lit(age).cast("int"), F.lit(disrupted))
    assert spark.range(1).select(c.alias("v")).first()["v"] == want


@pytest.mark.parametrize("cur,pred,ok,want", [(100.0, 97.0, True, "SELL"), (100.0, 103.0, True, "HOLD"), (100.0, 101.0, True, "WAIT"), (100.0, 150.0, False, None),
                                              (None, 100.0, True, None), (0.0, 100.0, True, None), (100.0, None, True, None)])
def test_advisory_needs_price_and_forecast(spark, cur, pred, ok, want):
    c = R.advisory_action(F.lit(cur).cast("double"), F.lit(pred).cast("double"), F.lit(ok))
    assert spark.range(1).select(c.alias("v")).first()["v"] == want


def test_missing_weather_stays_null(spark):
    df = spark.createDataFrame([(1, '{"hourly":{"temperature_2m":[]}}'), (2, '{"hourly":{"temperature_2m":[10,20],"precipitation":[7]}}'), (3, "broken")], "point_id int, payload string")
    got = {r["point_id"]: r for r in ad.weather_summary(df).collect()}
    assert got[1]["avg_temp"] is None and got[1]["total_rainfall"] is None and got[1]["weather_status"] == "UNAVAILABLE"
    assert (got[2]["avg_temp"], got[2]["avg_daily_rainfall"], got[2]["monthly_rainfall"], got[2]["avg_humidity"]) == (15.0, 1.0, 30.0, 0.0)
    assert got[3]["avg_temp"] is None


def test_weather_payloads_are_parsed_by_more_than_one_task(spark, tmp_path):
    from furrow.plans import advice as PA

    rows = [(k, k % 25, 1.0, "BUILDING") for k in range(400)]
    spark.createDataFrame(rows, "c_custkey long, c_nationkey long, c_acctbal double, c_mktsegment string").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    got = PA.weather_summary(spark, str(tmp_path)).select("point_id", F.spark_partition_id().alias("task")).collect()
    assert sorted(r["point_id"] for r in got) == list(range(400))
    per_task = [sum(r["task"] == t for r in got) for t in range(4)]
    assert min(per_task) >= 80


def test_forests_are_fitted_by_more_than_one_task(spark, monkeypatch):
    rows = spark.range(45_000, numPartitions=1)
    got = [r["n"] for r in md.dealt(rows).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(got) == 3 and sum(got) == 45_000 and min(got) >= 14_000
    few = spark.range(500, numPartitions=1)
    assert md.dealt(few) is few
    # Every fit of the cross validation goes through it, and all rows take part.
    seen = []
    monkeypatch.setattr(md, "dealt", lambda df: seen.append(df.count()) or df.repartition(3))
    folded = spark.range(60).selectExpr("id", "cast(id % 2 as string) AS label", "double(id % 2) AS x", "id % 5 AS fold")
    got = md.cross_validate(folded, ["x"], trees=3, depth=2).first()
    assert seen == [48] * 5 and (got["folds"], got["cv_mean"], got["cv_std"]) == (5, 1.0, 0.0)


def test_unknown_soil_is_never_suitable(spark):
    c = R.soil_status(F.lit(None).cast("double"), F.lit(5.5), F.lit(7.5))
    assert spark.range(1).select(c.alias("v")).first()["v"] == "UNKNOWN"


def test_recommendations_come_from_candidates(spark, sf):
    from furrow.plans import advice as PA
    pairs = PA.advice_scores(spark, sf).select("request_id", "crop")
    assert PA.advice_top5(spark, sf).join(pairs, ["request_id", "crop"], "left_anti").count() == 0


def test_versions_are_judged_by_the_production_model(spark):
    from furrow.operators import registry

    rows = [("a", 1, "2020-12-31", 100.0), ("a", 2, "2021-12-31", 200.0), ("a", 3, "2022-12-31", 190.0), ("a", 4, "2023-12-31", 109.0), ("b", 1, "2020-12-31", 5.0), ("b", 2, "2021-12-31", 4.0), ("b", 3, "2022-12-31", 4.41)]
    df = spark.createDataFrame(rows, "crop string, version bigint, trained_on string, mae double")
    got = {(r["crop"], r["version"]): r["status"] for r in registry.judge_versions(df).collect()}
    assert got == {("a", 1): "PROMOTED", ("a", 2): "REJECTED", ("a", 3): "REJECTED", ("a", 4): "PROMOTED", ("b", 1): "PROMOTED", ("b", 2): "PROMOTED", ("b", 3): "REJECTED"}


def test_evidence_points_take_every_arm(spark):
    from pyspark.sql import functions as F

    from furrow.functions import scoring

    rows = [(12, 20000.0, 0.5), (10, 9000.0, 0.5), (7, 1.0, 0.5), (5, 1.0, 0.5), (1, 1.0, 0.5), (0, 1.0, 0.5), (None, None, 0.5)]
    df = spark.createDataFrame(rows, "years bigint, production double, score double")
    got = [r[0] for r in df.select(scoring.evidence_points(F.col("years"), F.col("production"), F.col("score"))).collect()]
    assert got == [25.0, 20.0, 15.0, 15.0, 8.0, 4.0, 3.0]
