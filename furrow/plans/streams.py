"""Streaming jobs run to completion over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.operators import prices
from furrow.plans import news as PN
from furrow.plans import prices as PR
from furrow.plans import sql as S
from furrow.session import cut_lineage, scratch_path
from furrow.sources import tables as T
from furrow.streaming import jobs


def _stream(spark, sf, name: str):
    """One of the given tables as a stream of its files."""
    return jobs.read_table(spark, f"{sf.rstrip('/')}/{name}.parquet", T.table(spark, sf, name).schema)


def _paths(spark, label):
    base = scratch_path(spark, label)
    return f"{base}/table", f"{base}/checkpoint"


QUOTE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def streaming_quote_ingest(spark, sf):
    """All quotes as a stream over a stored history: only later days are appended.

    Every seventh order is delivered twice; a quote was delivered on its day and is named by its order, line, part and supplier.
    """
    table, checkpoint = _paths(spark, "quotes")
    known = cut_lineage(PR.daily(spark, sf).where(F.col("ds") < F.lit(T.SPLIT_DATE).cast("date")).select("ds", "crop", "state"), "history")
    lines = _stream(spark, sf, "lineitem")
    twice = F.explode(F.sequence(F.lit(1), F.when(F.col("l_orderkey") % 7 == 0, 2).otherwise(1)))
    sent = T.quote_lines(spark, sf, lines.withColumn("copy", twice), keep=QUOTE_KEY).withColumn("arrived", F.col("ds").cast("timestamp"))
    quotes = sent.select(*QUOTE_KEY, "arrived", "ds", F.lower("p_type").alias("crop"), F.col("n_name").alias("state"), "modal_cents", "min_cents", "max_cents")
    jobs.ingest_quotes(quotes, lambda: known, table, checkpoint, identity=[*QUOTE_KEY, "ds"], arrived="arrived")
    return prices.in_rupees(spark.read.parquet(table))


def streaming_article_ingest(spark, sf):
    table, checkpoint = _paths(spark, "articles")
    jobs.ingest_articles(T.articles_raw(spark, sf, _stream(spark, sf, "documents")), PN.RUN_TS, table, checkpoint, keep=["doc_id"])
    return spark.read.parquet(table).select("doc_id", "article_id", "title", "source_id", "tier")


def streaming_clusters(spark, sf):
    table, checkpoint = _paths(spark, "clusters")
    jobs.running_clusters(T.signals(spark, sf, _stream(spark, sf, "events")), table, checkpoint)
    return jobs.read_clusters(spark, table).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))


def streaming_source_sketches(spark, sf):
    table, checkpoint = _paths(spark, "sketches")
    jobs.cluster_sketches(T.signals(spark, sf, _stream(spark, sf, "events")), table, checkpoint)
    return jobs.read_sketches(spark, table).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))


def streaming_latest_price(spark, sf):
    table, checkpoint = _paths(spark, "latest")
    jobs.latest_prices(T.quotes(spark, sf, _stream(spark, sf, "lineitem")), table, checkpoint)
    return jobs.read_latest(spark, table, F.lit("2001-11-05").cast("date"))


QUERIES = {f.__name__: f for f in [streaming_quote_ingest, streaming_article_ingest, streaming_clusters, streaming_source_sketches, streaming_latest_price]}

ORACLES = {
    "streaming_quote_ingest": f"WITH {S.DAILY} SELECT {PR.RUPEES} FROM daily WHERE ds >= {PR.SPLIT}",
    "streaming_article_ingest": f"WITH {PN.ARTICLES} SELECT doc_id, article_id, title, source_id, tier FROM articles",
    "streaming_clusters": f"""WITH {S.SIGNALS}, w AS (SELECT *, CAST(floor(epoch(ts) / 1209600) AS BIGINT) AS k FROM signals)
 SELECT strftime(make_timestamp(k * 1209600 * 1000000), '%Y-%m-%d') AS window_start, state, crop, direction, count(*) AS event_count, count(DISTINCT source_name) AS unique_sources,
 CASE WHEN count(DISTINCT source_name) >= 2 THEN 'VERIFIED' ELSE 'SINGLE_SOURCE' END AS verification_status FROM w GROUP BY k, state, crop, direction""",
    # So few sources are counted exactly by a sketch.
    "streaming_source_sketches": f"""WITH {S.SIGNALS}, w AS (SELECT *, CAST(floor(epoch(ts) / 1209600) AS BIGINT) AS k FROM signals)
 SELECT strftime(make_timestamp(k * 1209600 * 1000000), '%Y-%m-%d') AS window_start, state, crop, direction, count(*) AS event_count, count(DISTINCT source_name) AS estimated_sources,
 CASE WHEN count(DISTINCT source_name) >= 2 THEN 'VERIFIED' ELSE 'SINGLE_SOURCE' END AS verification_status FROM w GROUP BY k, state, crop, direction""",
    "streaming_latest_price": f"""WITH {S.QUOTES}, r AS (SELECT *, row_number() OVER (PARTITION BY crop, state ORDER BY ds DESC, market DESC, modal_cents DESC) AS rn FROM quotes)
 SELECT crop, state, ds, market, {S.rs('modal_cents')} AS price, greatest(date_diff('day', ds, DATE '2001-11-05'), 0) AS data_age_days, date_diff('day', ds, DATE '2001-11-05') >= 3 AS expired FROM r WHERE rn = 1""",
}
