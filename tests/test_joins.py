"""Joins by intervals, contained names and shared words, and the rolling-origin back-test, against plain loops."""

import datetime as dt
import random

from pyspark.sql import functions as F

from furrow.operators import forecast as fc
from furrow.operators import intervals as iv
from furrow.operators import places as pl

DAY = dt.date(2020, 1, 1)


def test_interval_join_equals_nested_loop_on_dates(spark):
    r = random.Random(1)
    points = [(i, r.choice("ab"), None if i == 5 else DAY + dt.timedelta(r.randrange(-400, 400))) for i in range(80)]
    spans = [(k, r.choice("ab"), DAY + dt.timedelta(a), DAY + dt.timedelta(a + r.choice([-3, 0, 1, 31, 32, 500]))) for k, a in enumerate(r.randrange(-400, 400) for _ in range(60))]
    spans.append((99, "a", None, DAY))
    want = sorted((i, k) for i, g, d in points for k, h, a, b in spans if g == h and d and a and a <= d <= b)
    p = spark.createDataFrame(points, "i int, g string, d date")
    s = spark.createDataFrame(spans, "k int, g string, start_date date, end_date date")
    for width in (1, 32.0, 1000):
        got = iv.interval_join(p, s, "d", keys=["g"], width=width)
        assert got.columns == ["g", "i", "d", "k", "start_date", "end_date"] and sorted((x["i"], x["k"]) for x in got.collect()) == want
    # Both sides of the join grow with bins, not with days: 500 days are at most 17 bins of 32.
    assert s.where("k = 0").withColumn("b", F.explode(F.sequence(iv.bin_of(s, "start_date", 32), iv.bin_of(s, "start_date", 32) + 16))).count() == 17


def test_interval_join_equals_nested_loop_on_moments(spark):
    r = random.Random(2)
    at = lambda s: dt.datetime(1969, 12, 31, 23) + dt.timedelta(seconds=s)
    points = [(i, at(r.randrange(20_000))) for i in range(60)]
    spans = [(k, at(a), at(a + r.randrange(5_000))) for k, a in enumerate(r.randrange(20_000) for _ in range(40))]
    want = sorted((i, k) for i, t in points for k, a, b in spans if a <= t <= b)
    got = iv.interval_join(spark.createDataFrame(points, "i int, t timestamp"), spark.createDataFrame(spans, "k int, a timestamp, b timestamp"), "t", "a", "b", width=1 / 24)
    assert sorted((x["i"], x["k"]) for x in got.collect()) == want and want


def test_contained_pairs_equal_nested_loop(spark):
    r = random.Random(3)
    word = lambda n: "".join(r.choice("abcd é\U0001f600") for _ in range(n))
    texts = [word(r.randrange(0, 40)) for _ in range(60)] + [None, "", "aaaa"]
    names = [word(r.randrange(0, 6)) for _ in range(80)] + [None, "", "aaaa", "aaaaa"]
    want = {(t, n) for t in texts for n in names if t and n and n in t}
    rows = pl.contained_pairs(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(n,) for n in names], "name string")).collect()
    assert len(rows) == len(want) and {(x["text"], x["name"]) for x in rows} == want


def test_a_long_location_costs_rows_in_proportion(spark):
    r = random.Random(4)
    long = "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(10_000))
    df = spark.createDataFrame([(long,)], "t string")
    n = df.select(*[F.size(pl.grams(F.col("t"), k)).alias(f"n{k}") for k in (1, 2, 3)]).first()
    assert sum(n) <= 3 * len(long)
    m = spark.createDataFrame([(long[5000:5040], 1), ("nowhere in it", 2)], "key string, ord int")
    assert [x["ord"] for x in pl.match_names(df, m, name="t").collect()] == [1]


def test_word_overlap_equals_nested_loop(spark):
    r = random.Random(5)
    vocabulary = ["east", "district", "north", *(f"w{i}" for i in range(12))]
    name = lambda: " ".join(r.choices(vocabulary, weights=[9, 9, 5, *[1] * 12], k=r.randrange(0, 6)))
    names, master = [(r.choice("xy"), name()) for _ in range(120)], [(r.choice("xy"), name(), i) for i in range(60)]
    want = {}
    for s, n in names:
        hits = []
        for t, m, o in master:
            a, b = set(n.split()), set(m.split())
            if s == t and a and b and len(a & b) / len(a | b) >= 0.4:
                hits.append((-len(a & b) / len(a | b), o))
        if hits:
            want[s, n] = (min(hits)[1], -min(hits)[0])
    got = pl.token_overlap(spark.createDataFrame(names, "state_key string, folded string"), spark.createDataFrame(master, "state_key string, folded string, ord int"))
    assert {(x["state_key"], x["folded"]): (x["ord"], x["score"]) for x in got.collect()} == want and want


def test_district_info_falls_back_to_the_state(spark):
    districts = spark.createDataFrame([(1, "Nagpur", "Maharashtra", "Cotton", "Black"), (2, "Pur", "Elsewhere", "Rice", "Red")], "ord int, name string, state string, top_crops string, soil_type string")
    states = spark.createDataFrame([(1, "West Bengal", "Jute"), (2, "Bengal", "Rice")], "ord int, name string, top_crops string")
    asked = spark.createDataFrame([("nagpur ", "x"), ("Nagpur Rural", None), ("pur", None), ("Hooghly", "bengal"), ("Hooghly", "Goa"), (None, "Bengal"), ("", None)], "district string, state string")
    got = {(x["district"], x["state"]): (x["level"], x["district_name"], x["found_state"], x["top_crops"], x["soil_type"]) for x in pl.district_info(asked, districts, states).collect()}
    assert got == {
        ("nagpur ", "x"): ("EXACT", "Nagpur", "Maharashtra", "Cotton", "Black"), ("Nagpur Rural", None): ("PARTIAL", "Nagpur", "Maharashtra", "Cotton", "Black"),
        ("pur", None): ("EXACT", "Pur", "Elsewhere", "Rice", "Red"), ("Hooghly", "bengal"): ("STATE", "Hooghly", "West Bengal", "Jute", "Alluvial Soil"),
        (None, "Bengal"): ("STATE", None, "West Bengal", "Jute", "Alluvial Soil")}


def test_every_month_with_history_is_an_origin(spark):
    r = random.Random(6)
    days = sorted(r.sample(range(200), 90))
    rows = [(DAY + dt.timedelta(d), "rice", "Goa", 1000 + d) for d in days]
    daily = spark.createDataFrame(rows, "ds date, crop string, state string, y_cents bigint")
    origins = {x["origin"]: x for x in fc.monthly_origins(daily, least=15, pad_to=30).collect()}
    want = {}
    for i, (d, *_) in enumerate(rows):
        if i >= 15 and d.month != rows[i - 1][0].month:
            prior = [y / 100 for *_, y in rows[max(0, i - 30) : i]]
            want[d.replace(day=1)] = [prior[0]] * (30 - len(prior)) + prior
    assert {o: x["prices"] for o, x in origins.items()} == want and len(want) > 3
    # A path that stays at the last price is off by as many hundredths as days lie between.
    paths = fc.monthly_origins(daily).withColumn("path", F.array_repeat(F.element_at("prices", -1), 30))
    tested = {(x["origin"], x["horizon"]): (x["yhat"], x["y"]) for x in fc.backtest(paths, (1, 7, 30)).collect()}
    real = {d: y / 100 for d, _, _, y in rows}
    expect = {(o, h): (p[-1], real[o + dt.timedelta(h - 1)]) for o, p in want.items() for h in (1, 7, 30) if o + dt.timedelta(h - 1) in real}
    assert tested == expect and expect


def test_error_sums_do_not_depend_on_the_order(spark):
    r = random.Random(7)
    rows = [("rice", r.randrange(100, 10**7) / 100, r.randrange(10**8) / 30) for _ in range(500)]
    a = spark.createDataFrame(rows, "crop string, y double, yhat double")
    got = {tuple(fc.regression_metrics(d, ["crop"]).first()) for d in (a, a.orderBy("y").repartition(5), a.orderBy(F.desc("yhat")).coalesce(1))}
    assert len(got) == 1
    n, mae, rmse, mape, r2 = next(iter(got))[1:]
    e = [abs(y - p) for _, y, p in rows]
    mean = sum(y for _, y, _ in rows) / n
    assert n == 500 and abs(mae - sum(e) / n) < 0.006 and abs(rmse - (sum(x * x for x in e) / n) ** 0.5) < 0.006
    assert abs(mape - 100 * sum(x / max(y, 1) for x, (_, y, _) in zip(e, rows)) / n) < 0.006
    assert abs(r2 - (1 - sum(x * x for x in e) / sum((y - mean) ** 2 for _, y, _ in rows))) < 1e-3


def test_quotes_fall_back_level_by_level(spark):
    from furrow.operators import advice as ad

    quotes = [("A::x", "A", "x", "rice", 10.0, 1), ("A::x", "A", "x", "rice", 30.0, 2), ("A::x", "A", "x", "rice", 20.0, 2), (None, "A", "y", "rice", 5.0, 1),
              (None, None, "Z", "rice", 6.0, 1), (None, "b", None, "rice", 7.0, 1), (None, None, None, "rice", 9.0, 9)]
    q = spark.createDataFrame([(i, s, d, c, p, DAY + dt.timedelta(k)) for i, s, d, c, p, k in quotes], "canonical_id string, state string, district string, crop string, price double, ds date")
    latest = spark.createDataFrame([("D", "rice", DAY, 8.0), ("A", "wheat", DAY, 4.0)], "state string, crop string, ds date, price double")
    asked = [("a::X", "a", "X"), ("A::y", "A", "y"), ("Q::z", "Q", "z"), ("B::n", "B", "n"), ("D::n", "D", "n"), ("E::n", "E", "n"), ("B::n", "B", "n")]
    r = spark.createDataFrame([(i, s, d, "rice") for i, s, d in asked], "canonical_id string, state string, district string, crop string")
    got = {x["canonical_id"]: (x["level"], x["price"]) for x in ad.market_quote(r, q, latest).collect()}
    assert got == {"a::X": (1, 30.0), "A::y": (2, 5.0), "Q::z": (3, 6.0), "B::n": (4, 7.0), "D::n": (5, 8.0), "E::n": (0, None)}


def test_quantiles_equal_numpy_with_a_hot_group(spark):
    import numpy as np

    from furrow.operators import prices

    rng = np.random.default_rng(8)
    rows = [("hot", int(v)) for v in rng.integers(-50_000, 900_000, 4000)] + [("flat", 7)] * 500 + [("one", -3)] + [("none", None)]
    got = {r["g"]: r for r in prices.exact_quantiles(spark.createDataFrame(rows, "g string, v bigint"), "g", "v", [0.0, 0.25, 0.5, 0.99, 1.0]).collect()}
    assert set(got) == {"hot", "flat", "one"}
    for g in got:
        values = [v for h, v in rows if h == g]
        for p in (0.0, 0.25, 0.5, 0.99, 1.0):
            assert abs(got[g][f"q{int(round(p * 100))}"] - np.quantile(values, p)) < 1e-6
