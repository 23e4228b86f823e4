"""Sources, sinks, streaming replays and agreement with the SQL texts."""

import datetime as dt
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from furrow import schemas
from furrow.operators import clean, prices
from furrow.plans import catalog
from furrow.sources import files
from furrow.sources import tables as T
from furrow.streaming import jobs
from tools.check import TABLES, rows_of


def test_archive_skips_missing_years_and_bad_bytes(spark, tmp_path):
    head = ",".join(schemas.ARCHIVE_COLUMNS)
    (tmp_path / "2019.csv").write_bytes(f"{head}\nGoa,D,M,Wheat,V,G,2019-01-02,90,110,100,1\n".encode() + b"Go\xff,D,M,Wheat,V,G,03/01/2019,x,,0,1\n")
    (tmp_path / "2021.csv").write_text(f"{head}\nOrissa,D,M,Paddy(Common),V,G,01-02-2021,,,250.5,1\n")
    rows = files.read_archive(spark, str(tmp_path))
    assert rows.count() == 3
    checked = clean.check_archive(rows)
    good = {r["state"]: r for r in clean.accepted(checked).collect()}
    assert set(good) == {"Goa", "Odisha"} and good["Odisha"]["modal_cents"] == 25050 and good["Odisha"]["ds"] == dt.date(2021, 2, 1)
    assert {r["outcome"]: r["row_count"] for r in clean.reject_counts(checked).collect()} == {"ACCEPTED": 2, "BAD_PRICE": 1}
    assert files.read_archive(spark, str(tmp_path / "none")).count() == 0


def test_series_round_trip_with_defaults(spark, tmp_path):
    rows = spark.createDataFrame([(dt.date(2020, 1, 1), "rice", "Goa", 12.5, 10.0, 15.0, 2)], "ds date, crop string, state string, y double, min_price double, max_price double, market_count bigint")
    path = str(tmp_path / "series")
    files.append_series(rows, path)
    files.append_series(rows.withColumn("ds", F.date_add("ds", 1)), path)
    back = files.read_series(spark, path)
    assert back.count() == 2 and back.first()["rolling_std_7"] == 0.0
    assert files.series_in_cents(back).first()["y_cents"] == 1250
    # Absent measures get the zero of their type, so the file stays readable; absent keys are an error.
    files.append_series(spark.createDataFrame([(dt.date(2020, 2, k), "rice", "Kerala", 10.0 * k) for k in (1, 2)], "ds date, crop string, state string, y double"), path)
    more = {r["ds"].day: r for r in files.read_series(spark, path).where("state = 'Kerala'").collect()}
    assert more[2]["market_count"] == 0 and more[2]["min_price"] == 0.0 and more[1]["rolling_std_7"] == 0.0 and more[2]["rolling_std_7"] == pytest.approx(50**0.5)
    with pytest.raises(ValueError, match="state"):
        files.append_series(rows.drop("state"), path)


def test_report_is_one_document(spark, tmp_path, sf):
    path = str(tmp_path / "report")
    files.write_report(entry.queries()["coverage_totals"](spark, sf), path)
    parts = [f for f in os.listdir(path) if f.endswith(".json")]
    assert len(parts) == 1 and spark.read.json(path).count() == 1


def test_reference_documents(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"crop_requirements": {"Rice": {"soil_ph": {"min": 5.5, "max": 7.5}, "suitable_soils": ["Clay"]}}}')
    r = files.requirements_rows(files.read_document(spark, str(tmp_path / "r.json"), schemas.CROP_REQUIREMENTS)).first()
    assert r["crop"] == "Rice" and r["soil_ph"]["min"] == 5.5
    (tmp_path / "e.json").write_text('{"external_events": [{"event_id": "E", "affected_crops": ["Rice", "Wheat"], "start_date": "2024-01-01", "end_date": "2024-02-01"}]}')
    assert files.event_rows(files.read_document(spark, str(tmp_path / "e.json"), schemas.EXTERNAL_EVENTS)).count() == 2
    (tmp_path / "q.json").write_text('{"State": "Goa", "Commodity": "Rice", "Arrival_Date": "2024-01-01", "Modal_Price": 2100.5}\n')
    assert clean.accepted(clean.check_quotes(files.read_quote_json(spark, str(tmp_path / "q.json")))).first()["modal_cents"] == 210050


@pytest.fixture
def landed(spark, sf, tmp_path):
    """Quotes landed as three files."""
    folder = str(tmp_path / "landing")
    T.quotes(spark, sf).repartition(3, "market").write.parquet(folder)
    return folder


def test_quote_stream_is_idempotent(spark, landed, tmp_path):
    table, empty = str(tmp_path / "table"), spark.createDataFrame([], "ds date, crop string, state string")
    schema = spark.read.parquet(landed).schema
    for run in range(2):
        jobs.ingest_quotes(jobs.read_files(spark, landed, "*.parquet", schema, 1), lambda: empty, table, str(tmp_path / "cp"))
    got = spark.read.parquet(table)
    keys = spark.read.parquet(landed).select("ds", "crop", "state").distinct().count()
    assert got.count() == keys == got.select("ds", "crop", "state").distinct().count()
    # A fresh checkpoint finds all keys stored.
    jobs.ingest_quotes(jobs.read_files(spark, landed, "*.parquet", schema, 1), lambda: empty, table, str(tmp_path / "cp2"))
    assert spark.read.parquet(table).count() == keys


QUOTE = "crop string, state string, ds string, market string, min_cents bigint, max_cents bigint, modal_cents bigint"


def _quotes(spark, folder, rows):
    full = [(c, s, d, m, p - 10, p + 10, p) for c, s, d, m, p in rows]
    spark.createDataFrame(full, QUOTE).withColumn("ds", F.col("ds").cast("date")).coalesce(1).write.mode("append").parquet(str(folder))
    schema = spark.read.parquet(str(folder)).schema
    return lambda: jobs.read_files(spark, str(folder), "*.parquet", schema, 1)


def test_a_new_checkpoint_with_other_files_loses_nothing(spark, tmp_path):
    table, empty = str(tmp_path / "table"), spark.createDataFrame([], "ds date, crop string, state string")
    first = _quotes(spark, tmp_path / "a", [("rice", "Goa", "2024-01-01", "m", 100), ("rice", "Goa", "2024-01-02", "m", 100)])
    second = _quotes(spark, tmp_path / "b", [("rice", "Goa", "2024-01-02", "m", 300), ("wheat", "Goa", "2024-01-03", "m", 100)])
    jobs.ingest_quotes(first(), lambda: empty, table, str(tmp_path / "cp"))
    jobs.ingest_quotes(second(), lambda: empty, table, str(tmp_path / "cp2"))
    got = {(r["crop"], str(r["ds"])): r["y_cents"] for r in spark.read.parquet(table).collect()}
    assert set(got) == {("rice", "2024-01-01"), ("rice", "2024-01-02"), ("wheat", "2024-01-03")}
    run = jobs.run_id(spark, str(tmp_path / "cp2"))
    assert {r["run"] for r in spark.read.parquet(table).select("run").distinct().collect()} == {run, jobs.run_id(spark, str(tmp_path / "cp"))}


def test_latest_prices_go_on_with_a_new_checkpoint(spark, tmp_path):
    table, day = str(tmp_path / "latest"), F.lit("2024-01-05").cast("date")
    first = _quotes(spark, tmp_path / "a", [("rice", "Goa", "2024-01-01", "m", 100)])
    jobs.latest_prices(first(), table, str(tmp_path / "cp"))
    second = _quotes(spark, tmp_path / "b", [("rice", "Goa", "2024-01-04", "m", 300), ("rice", "Goa", "2024-01-04", "k", 200), ("rice", "Kerala", "2024-01-02", "m", 200)])
    third = _quotes(spark, tmp_path / "c", [("rice", "Goa", "2024-01-02", "m", 900)])
    for stream, cp in ((second, "cp2"), (third, "cp3"), (second, "cp2")):
        jobs.latest_prices(stream(), table, str(tmp_path / cp))
    got = {r["state"]: (str(r["ds"]), r["price"]) for r in jobs.read_latest(spark, table, day).collect()}
    assert got == {"Goa": ("2024-01-04", 3.0), "Kerala": ("2024-01-02", 2.0)}


def _sent(spark, folder, rows, schema="quote_id bigint, arrived string, ds string, crop string, state string, modal_cents bigint"):
    """One more file of delivered quotes, and the stream over all of them."""
    df = spark.createDataFrame(rows, schema).withColumn("arrived", F.col("arrived").cast("timestamp")).withColumn("ds", F.col("ds").cast("date"))
    df.withColumn("min_cents", F.col("modal_cents")).withColumn("max_cents", F.col("modal_cents")).coalesce(1).write.mode("append").parquet(str(folder))
    return jobs.read_files(spark, str(folder), "*.parquet", spark.read.parquet(str(folder)).schema, 1)


def test_quotes_sent_again_count_once_across_batches_and_restarts(spark, tmp_path):
    folder, table, cp = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "cp")
    empty = spark.createDataFrame([], "ds date, crop string, state string")

    def ingest(rows):
        return jobs.ingest_quotes(_sent(spark, folder, rows), lambda: empty, table, cp, identity=["quote_id"], arrived="arrived")

    def stored():
        return {(str(r["ds"]), r["crop"]): (r["y_cents"], r["market_count"]) for r in spark.read.parquet(table).collect()}

    # Twice in one batch: the mean counts quote 1 once.
    first = ingest([(1, "2024-01-10", "2024-01-09", "rice", "Goa", 100), (1, "2024-01-11", "2024-01-09", "rice", "Goa", 100), (2, "2024-01-10", "2024-01-09", "rice", "Goa", 400)])
    assert first.repeated == 1 and first.late == 0 and stored() == {("2024-01-09", "rice"): (250, 2)}
    # Sent again after a restart, under a day that is not stored: still known.  An old market day is not late.
    again = ingest([(2, "2024-01-12", "2024-01-08", "rice", "Goa", 400), (3, "2024-01-12", "2019-05-05", "rice", "Goa", 700)])
    assert again.repeated == 1 and again.late == 0 and stored() == {("2024-01-09", "rice"): (250, 2), ("2019-05-05", "rice"): (700, 1)}
    ingest([(4, "2024-02-01", "2024-01-31", "wheat", "Goa", 900)])
    # Delivered before the watermark: left out and counted.  Within it: taken.  Ids past it are forgotten.
    late = ingest([(5, "2024-01-20", "2024-01-19", "wheat", "Goa", 900), (6, "2024-01-30", "2024-01-29", "wheat", "Goa", 800), (1, "2024-02-01", "2024-01-28", "rice", "Goa", 100)])
    assert late.late == 1 and late.repeated == 0
    assert set(stored()) == {("2024-01-09", "rice"), ("2019-05-05", "rice"), ("2024-01-31", "wheat"), ("2024-01-29", "wheat"), ("2024-01-28", "rice")}
    assert ingest([(6, "2024-01-31", "2024-01-27", "wheat", "Goa", 800)]).repeated == 1


def test_latest_price_state_is_kept_and_expires(spark, tmp_path):
    folder, table, cp = tmp_path / "a", str(tmp_path / "latest"), str(tmp_path / "cp")

    def changes():
        return sorted((r["state"], str(r["ds"]), r["change"]) for r in spark.read.parquet(table).collect())

    def run(rows, ttl_ms):
        jobs.latest_prices(_quotes(spark, folder, rows)(), table, cp, ttl_ms)

    run([("rice", "Goa", "2024-01-05", "m", 100), ("rice", "Goa", "2024-01-04", "m", 900)], 600_000)
    assert changes() == [("Goa", "2024-01-05", "UPDATED")]
    # A restart knows the key: an older quote and the same quote change nothing.
    run([("rice", "Goa", "2024-01-03", "m", 700)], 600_000)
    assert changes() == [("Goa", "2024-01-05", "UPDATED")]
    # Confirmed with a short time to live, the key leaves the state in the next run ...
    run([("rice", "Goa", "2024-01-05", "m", 100), ("rice", "Kerala", "2024-01-06", "m", 300)], 1)
    run([("wheat", "Punjab", "2024-01-07", "m", 500)], 600_000)
    assert [c for c in changes() if c[2] == "EXPIRED"] == [("Goa", "2024-01-05", "EXPIRED"), ("Kerala", "2024-01-06", "EXPIRED")]
    # ... so an older quote is a change again, which the reader does not take for the latest.
    run([("rice", "Goa", "2024-01-01", "m", 50)], 600_000)
    assert ("Goa", "2024-01-01", "UPDATED") in changes()
    got = {r["state"]: (str(r["ds"]), r["price"], r["expired"]) for r in jobs.read_latest(spark, table, F.lit("2024-01-08").cast("date")).collect()}
    assert got == {"Goa": ("2024-01-05", 1.0, True), "Kerala": ("2024-01-06", 3.0, False), "Punjab": ("2024-01-07", 5.0, False)}


def test_sketches_merge_to_nearly_the_exact_number_of_sources(spark, tmp_path):
    table = str(tmp_path / "sketches")
    whole = None
    for k in range(2):
        folder = str(tmp_path / f"in{k}")
        df = spark.range(k * 3000, k * 3000 + 6000).select(
            F.lit("2024-01-02").cast("timestamp").alias("ts"), F.when(F.col("id") % 3 == 0, "Goa").otherwise("Kerala").alias("state"), F.lit("rice").alias("crop"),
            F.when(F.col("id") < 5, "DOWN").otherwise("UP").alias("direction"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("source_name"))
        df.write.parquet(folder)
        whole = df if whole is None else whole.union(df)
        jobs.cluster_sketches(jobs.read_files(spark, folder, "*.parquet", df.schema), table, str(tmp_path / f"cp{k}"))
    keys = ["state", "crop", "direction"]
    per_batch = spark.read.parquet(table).groupBy("run", "batch_id", *keys).count()
    assert per_batch.where("count > 1").count() == 0
    exact = {tuple(r[:3]): (r[3], r[4]) for r in whole.groupBy(*keys).agg(F.count("*"), F.countDistinct("source_name")).collect()}
    got = {(r["state"], r["crop"], r["direction"]): (r["event_count"], r["estimated_sources"]) for r in jobs.read_sketches(spark, table).collect()}
    assert got.keys() == exact.keys() and all(got[k][0] == exact[k][0] for k in exact)
    assert all(abs(got[k][1] - exact[k][1]) <= 0.05 * exact[k][1] for k in exact) and got[("Goa", "rice", "DOWN")][1] == 2


def test_an_old_article_is_not_stored_again(spark, sf, tmp_path):
    table = str(tmp_path / "articles")
    docs = T.table(spark, sf, "documents")
    for k, ts in enumerate(("2024-01-01 00:00:00", "2024-03-01 00:00:00")):
        folder = str(tmp_path / f"in{k}")
        docs.where(F.col("doc_id") < 40 + 20 * k).coalesce(1).write.parquet(folder)
        stream = jobs.read_files(spark, folder, "*.parquet", docs.schema)
        jobs.ingest_articles(T.articles_raw(spark, sf, stream), ts, table, str(tmp_path / f"cp{k}"), keep=["doc_id"])
    rows = spark.read.parquet(table)
    assert rows.count() == rows.select("article_id").distinct().count()
    assert rows.where("fetched_at > '2024-02-01' AND doc_id < 40").count() == 0 and rows.where("doc_id >= 40").count() > 0


def test_a_table_of_several_files_is_streamed_whole(spark, tmp_path):
    from furrow.plans import streams

    rows = [(k, f"Headline {k}\nbody of {k}", "en", f"src{k % 3}", 20) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, files in (("several", 20), ("one", 1)):
        folder = tmp_path / name / "documents.parquet"
        docs.repartition(files).write.parquet(str(folder))
        if files == 1:
            part, = folder.glob("part-*.parquet")
            (tmp_path / "file").mkdir()
            part.rename(tmp_path / "file" / "documents.parquet")
    for name in ("several", "file"):
        got = streams.streaming_article_ingest(spark, str(tmp_path / name)).collect()
        assert sorted((r["doc_id"], r["title"]) for r in got) == [(k, f"Headline {k}") for k in range(60)]


def test_clusters_add_up_over_batches_and_runs(spark, tmp_path):
    table = str(tmp_path / "clusters")
    for k, rows in enumerate(([("2024-01-01", "a"), ("2024-01-02", "a")], [("2024-01-03", "b"), ("2023-01-01", "c")])):
        folder = str(tmp_path / f"in{k}")
        df = spark.createDataFrame([(d, "Goa", "rice", "UP", s) for d, s in rows], "ts string, state string, crop string, direction string, source_name string")
        df.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(folder)
        jobs.running_clusters(jobs.read_files(spark, folder, "*.parquet", spark.read.parquet(folder).schema), table, str(tmp_path / f"cp{k}"))
    got = sorted((r["event_count"], r["unique_sources"], r["verification_status"]) for r in jobs.read_clusters(spark, table).collect())
    assert got == [(1, 1, "SINGLE_SOURCE"), (3, 2, "VERIFIED")]


def test_latest_stream_equals_batch(spark, landed, tmp_path):
    table = str(tmp_path / "latest")
    schema = spark.read.parquet(landed).schema
    jobs.latest_prices(jobs.read_files(spark, landed, "*.parquet", schema, 1), table, str(tmp_path / "cp"))
    day = F.lit("2001-11-05").cast("date")
    got = {(r["crop"], r["state"]): (r["ds"], r["price"]) for r in jobs.read_latest(spark, table, day).collect()}
    want = {(r["crop"], r["state"]): (r["arrival_date"], r["price"]) for r in prices.latest_price(spark.read.parquet(landed), day).collect()}
    assert got == want


def test_every_check_text_names_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


# The registered check texts; those of the optional subpackage have their own tests.
NAMES = sorted(catalog.oracle_sql())


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_sql(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows_of(names, cur.fetchall())


def test_an_increment_touches_its_own_months_only(spark, tmp_path):
    from furrow.sources import store

    table = str(tmp_path / "months")
    quotes = lambda rows: spark.createDataFrame(rows, "ds string, crop string, state string, modal_cents bigint, min_cents bigint, max_cents bigint").withColumn("ds", F.col("ds").cast("date"))
    months = [f"20{y:02d}-{m:02d}" for y in range(10, 14) for m in range(1, 13)]
    store.merge_increment(quotes([(f"{m}-05", "rice", "Goa", 100, 90, 110) for m in months]), table)
    files_of = lambda rows: {r[0].split("/month=")[1] for r in rows.select(F.input_file_name()).distinct().collect()}
    before = files_of(store.read_months(spark, table))
    assert len(before) == len(months)
    new = quotes([("2013-12-05", "rice", "Goa", 500, 1, 1), ("2013-12-06", "rice", "Goa", 200, 1, 1), ("2013-12-06", "rice", "Goa", 300, 1, 1), ("2014-01-01", "rice", "Goa", 700, 1, 1)])
    # What an increment of these months reads is one file a month, however long the history.
    two = store.read_months(spark, table, ["2013-12", "2014-01"])
    assert {f.split("/")[0] for f in files_of(two)} == {"2013-12"}
    plan = two._jdf.queryExecution().executedPlan().toString()
    assert "month" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert store.merge_increment(new, table) == ["2013-12", "2014-01"]
    after = files_of(store.read_months(spark, table))
    assert {f.split("/")[0] for f in before - after} == {"2013-12"} and len(after) == len(months) + 1
    got = {str(r["ds"]): r["y_cents"] for r in store.read_months(spark, table, ["2013-12", "2014-01"]).collect()}
    assert got == {"2013-12-05": 100, "2013-12-06": 250, "2014-01-01": 700}
    # A replay writes nothing, and many small increments leave one file a month.
    assert store.merge_increment(new, table) == [] and files_of(store.read_months(spark, table)) == after
    for d in range(10, 14):
        store.merge_increment(quotes([(f"2014-01-{d}", "rice", "Goa", d, 1, 1)]), table)
    assert len(files_of(store.read_months(spark, table))) == len(after) and store.read_months(spark, table, ["2014-01"]).count() == 5
