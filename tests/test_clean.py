"""Literal cases of names, dates, prices and request checks."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from furrow import dims
from furrow.functions import dates as D
from furrow.functions import numeric as N
from furrow.functions import text as X
from furrow.operators import clean


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("raw,want", [("maharashtra", "Maharashtra"), (" ORISSA ", "Odisha"), ("chattisgarh", "Chhattisgarh"),
                                      ("new-land east", "New-Land East"), ("  ", None)])
def test_state_names(spark, raw, want):
    assert one(spark, X.normalize_state(F.lit(raw))) == want


@pytest.mark.parametrize("raw,want", [("Paddy(Dhan)(Common)", "rice"), ("Wheat", "wheat"), ("UnknownCrop", None)])
def test_exact_crop(spark, raw, want):
    assert one(spark, X.exact_crop(F.lit(raw))) == want


def test_contained_crop_takes_the_first_fragment(spark):
    assert one(spark, X.contained_crop(F.lit("Hybrid Maize with Wheat"))) == "wheat"
    assert one(spark, X.contained_crop(F.lit("Turmeric"))) is None


@pytest.mark.parametrize("raw,want", [("15/08/2026", dt.date(2026, 8, 15)), ("2026-08-15", dt.date(2026, 8, 15)), ("15.08.2026", dt.date(2026, 8, 15)),
                                      ("2026/08/15", dt.date(2026, 8, 15)), ("31/02/2026", None), ("15/08/26", None), ("2026-08-15x", None), ("", None)])
def test_quote_dates(spark, raw, want):
    assert one(spark, D.parse_date(F.lit(raw))) == want


def test_archive_dates_try_day_first_then_month_first(spark):
    got = [one(spark, D.parse_date(F.lit(x), dims.ARCHIVE_DATE_FORMATS)) for x in ("03/04/2020", "04/23/2020")]
    assert got == [dt.date(2020, 4, 3), dt.date(2020, 4, 23)]


@pytest.mark.parametrize("raw,want", [
    ("Mon, 01 Jan 2024 10:00:00 +0530", "2024-01-01 04:30:00"), ("Mon, 01 Jan 2024 10:00:00 GMT", "2024-01-01 10:00:00"),
    ("2024-01-01T10:00:00+00:00", "2024-01-01 10:00:00"), ("2024-01-01", "2024-01-01 00:00:00"), ("soon", "2024-05-01 00:00:00")])
def test_publication_stamps(spark, raw, want):
    col = D.parse_published(F.lit(raw), F.lit("2024-05-01").cast("timestamp"))
    assert one(spark, F.date_format(col, "yyyy-MM-dd HH:mm:ss")) == want


def test_age_ladders(spark):
    ages = [0, 3, 4, 14, 15, 30, 31, 60, 61, 180, 181]
    want = ["VERY_FRESH"] * 2 + ["FRESH"] * 2 + ["RECENT"] * 2 + ["BACKGROUND"] * 2 + ["STALE"] * 2 + ["VERY_STALE"]
    rows = spark.createDataFrame([(a,) for a in ages], "a int").select(D.ladder(F.col("a"), "market").alias("l")).collect()
    assert [r["l"] for r in rows] == want
    assert one(spark, D.ladder(F.lit(None).cast("int"), "market")) is None


def test_plain_number_and_rounding(spark):
    texts = {"12": True, "12.5": True, ".5": True, "1.2.3": False, "-1": False, "1e3": False, "": False}
    for t, want in texts.items():
        assert one(spark, N.plain_number(F.lit(t))) is want
    assert one(spark, N.round_to(F.lit(-4.36), 1)) == -4.4


def test_futures_conversion(spark):
    got = one(spark, N.futures_to_quintal(F.lit(560.0), F.lit("cents_bushel"), F.lit(27.2155), F.lit(83.5), F.lit(0.95)))
    assert got == pytest.approx(round(round(5.6 / 27.2155 * 100 * 83.5, 2) * 0.95, 2), abs=0.011)


def quote(**kw):
    base = {"state": "punjab", "commodity": "wheat", "arrival_date": "15/08/2026", "modal_price": "2250", "min_price": "2100", "max_price": "2300"}
    return {**base, **kw}


def test_quote_checks(spark):
    rows = [quote(), quote(modal_price="-500.0"), quote(min_price="", max_price="0"), quote(min_price="2300", max_price="2100"), quote(commodity="Fig"),
            quote(arrival_date="soon"), quote(state=" "), quote(min_price="abc"), quote(modal_price="99.99"), quote(modal_price="45000", max_price="1")]
    df = spark.createDataFrame([(i, *r.values()) for i, r in enumerate(rows)], "id int, " + ", ".join(f"{k} string" for k in rows[0]))
    got = {r["id"]: r for r in clean.check_quotes(df, keep=["id"]).collect()}
    assert (got[0]["state"], got[0]["crop"], got[0]["modal_cents"], got[0]["range_cents"]) == ("Punjab", "wheat", 225000, 20000)
    assert (got[2]["min_cents"], got[2]["max_cents"]) == (225000, 225000)
    assert (got[3]["min_cents"], got[3]["max_cents"]) == (210000, 230000)
    reasons = {i: r["reject_reason"] for i, r in got.items()}
    assert reasons == {0: None, 1: "PRICE_OUT_OF_BOUNDS", 2: None, 3: None, 4: "UNKNOWN_CROP", 5: "BAD_DATE", 6: "MISSING_STATE", 7: "BAD_NUMBER",
                       8: "PRICE_OUT_OF_BOUNDS", 9: None}


def test_alternative_spellings(spark):
    df = spark.createDataFrame([("Bihar", "Onion", "2026-01-02", "1500")], "State string, Commodity string, date string, modal_price_rs_qtl string")
    r = clean.accepted(clean.check_quotes(df)).first()
    assert (r["state"], r["crop"], r["modal_cents"]) == ("Bihar", "onion", 150000)


def test_request_checks(spark):
    schema = "state string, district string, n double, p double, k double, soil_ph double, lat double, lon double"
    rows = [("A", "B", None, None, None, None, None, None), ("", "B", 1.0, 1.0, 1.0, 7.0, 0.0, 0.0), ("A", "B", 1.0, 301.0, 1.0, 7.0, 0.0, 0.0),
            ("A", "B", 1.0, 1.0, 1.0, 0.5, 0.0, 0.0), ("A", "B", 1.0, 1.0, 1.0, 7.0, 91.0, 0.0)]
    got = [r["invalid_reason"] for r in clean.validate_requests(spark.createDataFrame(rows, schema)).collect()]
    assert got == [None, "STATE_MISSING", "P_OUT_OF_RANGE", "SOIL_PH_OUT_OF_RANGE", "LAT_OUT_OF_RANGE"]


def test_markup_and_whitespace(spark):
    raw = "a <b>bold</b>\t\n word    end  <br/>"
    assert one(spark, X.strip_markup(F.lit(raw))) == "a bold word end"


def test_forbidden_text(spark):
    assert one(spark, X.has_forbidden(F.lit("score 25.0/25")))
    assert one(spark, X.has_forbidden(F.lit("MAE of 3")))
    assert not one(spark, X.has_forbidden(F.lit("Rs.2,100/quintal")))
