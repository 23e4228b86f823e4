"""Quote cleaning with a reason for every rejected row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow import dims
from furrow.functions import dates as D
from furrow.functions import numeric as N
from furrow.functions import text as X

# Spellings under which a landed record may carry each field, best first.
# Fixed values.
FIELD_SPELLINGS = {
    "commodity": ["commodity", "Commodity"],
    "state": ["state", "State"],
    "arrival_date": ["arrival_date", "Arrival_Date", "date"],
    "modal_price": ["modal_price", "Modal_Price", "modal_price_rs_qtl"],
    "min_price": ["min_price", "Min_Price", "min_price_rs_qtl"],
    "max_price": ["max_price", "Max_Price", "max_price_rs_qtl"],
}


def unify_fields(raw: DataFrame, spellings: Mapping[str, Sequence[str]] = FIELD_SPELLINGS,
                 keep: Sequence[str] = ()) -> DataFrame:
    """One schema from records that spell their fields differently."""
    present = set(raw.columns)
    out = [F.col(k) for k in keep]
    for name, options in spellings.items():
        found = [F.col(f"`{o}`").cast("string") for o in options if o in present]
        out.append((X.first_present(*found) if found else F.lit(None).cast("string")).alias(name))
    return raw.select(*out)


def settle(df: DataFrame, *cols: Column) -> DataFrame:
    """Project ``cols`` so that each is computed once per row.

    A later filter on a plain projection is pushed below it with every
    expression copied into the predicate; for parsing chains that multiplies
    the work.  Emitting the row through a generator keeps the filter above.
    """
    return df.select(F.explode(F.array(F.struct(*cols))).alias("row")).select("row.*")


def _reason(rules: Sequence[tuple[str, Column]]) -> Column:
    out = None
    for label, failed in rules:
        failed = F.coalesce(failed, F.lit(True))
        out = F.when(failed, F.lit(label)) if out is None else out.when(failed, F.lit(label))
    return out


def check_quotes(raw: DataFrame, keep: Sequence[str] = (), bounds: tuple[float, float] = dims.MODAL_BOUNDS,
                 crops: Sequence[str] = tuple(dims.PRICE_CROPS)) -> DataFrame:
    """Normalize and judge incremental quotes; ``reject_reason`` is null for good rows.

    Bounds apply to the modal price.  A missing minimum or maximum becomes the
    modal price, inverted bounds are swapped and both are widened to hold it.
    """
    r = unify_fields(raw, keep=keep)
    # Python-style "or": empty text and zero both count as absent.
    def number(c: str) -> Column:
        return F.nullif(F.col(c).try_cast("double"), F.lit(0.0))

    def unreadable(c: str) -> Column:
        return (F.coalesce(F.trim(c), F.lit("")) != "") & F.col(c).try_cast("double").isNull()

    modal = F.coalesce(number("modal_price"), F.lit(0.0))
    parsed = settle(
        r, *[F.col(k) for k in keep], X.exact_crop(F.col("commodity")).alias("crop"),
        X.normalize_state(F.col("state")).alias("state"),
        D.parse_date(F.col("arrival_date")).alias("ds"), modal.alias("modal"),
        F.coalesce(number("min_price"), modal).alias("lo"), F.coalesce(number("max_price"), modal).alias("hi"),
        (unreadable("modal_price") | unreadable("min_price") | unreadable("max_price")).alias("bad_number"))
    reason = _reason([
        ("UNKNOWN_CROP", ~F.col("crop").isin(*crops)), ("MISSING_STATE", F.col("state").isNull()),
        ("BAD_DATE", F.col("ds").isNull()), ("BAD_NUMBER", F.col("bad_number")),
        ("PRICE_OUT_OF_BOUNDS", ~F.col("modal").between(*bounds))])
    low = F.least("lo", "hi", "modal")
    high = F.greatest("lo", "hi", "modal")
    return parsed.select(
        *keep, "ds", "crop", "state", N.cents(F.col("modal")).alias("modal_cents"),
        N.cents(low).alias("min_cents"), N.cents(high).alias("max_cents"),
        N.cents(high - low).alias("range_cents"), reason.alias("reject_reason"))


def check_archive(raw: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Normalize and judge rows of the yearly archive (positive price, contained crop name)."""
    r = unify_fields(raw, keep=keep)
    modal = F.trim("modal_price").try_cast("double")
    parsed = settle(
        r, *[F.col(k) for k in keep], X.contained_crop(F.col("commodity")).alias("crop"),
        X.normalize_state(F.col("state"), title_on_miss=False).alias("state"),
        D.parse_date(F.col("arrival_date"), dims.ARCHIVE_DATE_FORMATS).alias("ds"), modal.alias("modal"),
        N.lenient_double(F.col("min_price")).alias("lo"), N.lenient_double(F.col("max_price")).alias("hi"))
    reason = _reason([
        ("MISSING_STATE", F.col("state").isNull()), ("UNKNOWN_CROP", F.col("crop").isNull()),
        ("BAD_PRICE", ~(F.col("modal") > 0)), ("BAD_DATE", F.col("ds").isNull())])
    return parsed.select(
        *keep, "ds", "crop", "state", N.cents(F.coalesce("modal", F.lit(0.0))).alias("modal_cents"),
        N.cents(F.col("lo")).alias("min_cents"), N.cents(F.col("hi")).alias("max_cents"),
        reason.alias("reject_reason"))


def accepted(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("reject_reason").isNull()).drop("reject_reason")


def reject_counts(checked: DataFrame) -> DataFrame:
    """Rows per outcome; accepted rows are counted as ACCEPTED."""
    return (checked.groupBy(F.coalesce("reject_reason", F.lit("ACCEPTED")).alias("outcome"))
            .agg(F.count(F.lit(1)).alias("row_count")))


def ingest_accounting(checked: DataFrame, existing: DataFrame) -> DataFrame:
    """One row: raw, valid, rejected, duplicate and added counts of an ingest."""
    keys = ["ds", "crop", "state"]
    known = existing.select(*keys, F.lit(True).alias("known"))
    good = F.col("reject_reason").isNull()
    # Rejected rows share one key, so the table shrinks to the distinct keys plus one row.
    per_key = checked.groupBy(*[F.when(good, F.col(k)).alias(k) for k in keys], good.alias("good")).agg(F.count(F.lit(1)).alias("n"))
    ok, new = F.col("good"), F.col("good") & F.col("known").isNull()
    zero = F.lit(0).cast("bigint")

    def total(when: Column) -> Column:
        return F.coalesce(F.sum(F.when(when, F.col("n")).otherwise(zero)), zero)

    return per_key.join(known, keys, "left").agg(
        total(F.lit(True)).alias("raw"), total(ok).alias("valid"), total(~ok).alias("rejected"), F.count_if(new).alias("added")).select(
        "raw", "valid", "rejected", (F.col("valid") - F.col("added")).alias("duplicate"), "added")


def validate_requests(requests: DataFrame) -> DataFrame:
    """Range checks of advice requests: ``invalid_reason`` is null for good rows.

    Nutrients 0-300, pH 1-14, latitude and longitude in range, required names
    present; absent optional values pass.
    """
    def outside(c: str, low: float, high: float) -> Column:
        return F.coalesce(~F.col(c).between(low, high), F.lit(False))

    checks = [("n", 0.0, 300.0), ("p", 0.0, 300.0), ("k", 0.0, 300.0), ("soil_ph", 1.0, 14.0),
              ("lat", -90.0, 90.0), ("lon", -180.0, 180.0)]
    rules = [("STATE_MISSING", F.coalesce(F.trim("state"), F.lit("")) == ""),
             ("DISTRICT_MISSING", F.coalesce(F.trim("district"), F.lit("")) == "")]
    rules += [(f"{c.upper()}_OUT_OF_RANGE", outside(c, lo, hi)) for c, lo, hi in checks]
    return requests.withColumn("invalid_reason", _reason(rules))


def validate_outlook_requests(requests: DataFrame, crops: Sequence[str] = tuple(dims.PRICE_CROPS),
                              horizons: Sequence[int] = (7, 15, 30, 60, 90)) -> DataFrame:
    rules = [("CROP_NOT_SUPPORTED", ~X.key(F.col("crop")).isin(*crops)),
             ("HORIZON_NOT_SUPPORTED", ~F.col("horizon_days").isin(*horizons))]
    return requests.withColumn("invalid_reason", _reason(rules))


def latest_plain_batch(raw: DataFrame, as_of: Column, by: Sequence[str] = ("commodity",)) -> DataFrame:
    """Mean of the readable prices of the latest arrival day per key, with the age of that day.

    Only texts of digits with at most one dot are prices; a key whose latest day has none is
    absent, as is one without a readable day.  Days are summed first, so a key with very many records is one row a
    task and day.
    """
    r = unify_fields(raw)
    parsed = settle(r, *[F.trim(k).alias(k) for k in by], D.parse_date(F.col("arrival_date"), dims.OBSERVATION_DATE_FORMATS).alias("ds"),
                    F.when(N.plain_number(F.col("modal_price")), N.cents(F.col("modal_price").try_cast("double"))).alias("cents"))
    days = parsed.where(F.col("ds").isNotNull()).groupBy(*by, "ds").agg(F.sum("cents").alias("s"), F.count("cents").alias("n"))
    last = days.groupBy(*by).agg(F.max_by(F.struct("ds", "s", "n"), "ds").alias("b")).where("b.n > 0")
    age = D.age_days(as_of, F.col("b.ds"))
    return last.select(*by, F.col("b.ds").alias("ds"), F.col("b.n").alias("prices"), N.round_to(F.col("b.s").cast("double") / F.col("b.n") / F.lit(100.0), 2).alias("avg_price"),
                       age.cast("bigint").alias("data_age_days"), D.ladder(age, "market").alias("freshness_label"))
