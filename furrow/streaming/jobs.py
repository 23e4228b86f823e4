"""Incremental ingest, running clusters and latest prices as streaming jobs.

Each job reads what is new, writes, and stops (``availableNow``), so it can be
scheduled; a long-running trigger works with the same code.  A job has a run id
that lives in its checkpoint; what a batch writes goes under run and batch
number and is overwritten on replay, so losing an executor or the driver in
mid-batch never adds a row twice, and a job with a new checkpoint adds to what
others stored instead of replacing it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from furrow.functions import numeric as N
from furrow.operators import news, prices

KEYS = ["ds", "crop", "state"]


def read_files(spark: SparkSession, folder: str, pattern: str, schema, files_per_batch: int = 16) -> DataFrame:
    """Stream of the parquet files of a folder that match a name pattern."""
    return (spark.readStream.schema(schema).option("pathGlobFilter", pattern)
            .option("maxFilesPerTrigger", files_per_batch).parquet(folder))


def _located(spark: SparkSession, path: str):
    """The file system of a path, and the path on it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    store, p = _located(spark, path)
    return store.exists(p)


def read_table(spark: SparkSession, path: str, schema, files_per_batch: int = 16) -> DataFrame:
    """Stream of a stored parquet table, be it one file or a folder of files."""
    store, p = _located(spark, path)
    if store.getFileStatus(p).isDirectory():
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    folder, name = path.rsplit("/", 1)
    return read_files(spark, folder, name, schema, files_per_batch)


def run_id(spark: SparkSession, checkpoint: str) -> str:
    """The run that a checkpoint belongs to, made with the checkpoint."""
    path = f"{checkpoint}/run"
    if not _exists(spark, path):
        spark.createDataFrame([(f"r{uuid.uuid4().hex}",)], "value string").coalesce(1).write.text(path)
    return spark.read.text(path).first()[0]


def batch_path(table: str, run: str, batch_id: int) -> str:
    return f"{table}/run={run}/batch_id={batch_id}"


def read_batches(spark: SparkSession, table: str, schema: StructType, run: str | None = None, batch_id: int | None = None) -> DataFrame:
    """All stored rows, but for those of one batch if it is named."""
    full = StructType([*schema.fields, StructField("run", StringType()), StructField("batch_id", LongType())])
    if not _exists(spark, table):
        return spark.createDataFrame([], full)
    rows = spark.read.schema(full).parquet(table)
    return rows if run is None else rows.where((F.col("run") != run) | (F.col("batch_id") != batch_id))


class Delivery(NamedTuple):
    """What a run's deduplication left out: rows sent again, and rows older than the watermark."""

    repeated: int
    late: int


def _each_batch(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> Delivery:
    """Run the stream to its end; all progress of the run is read when it is over."""
    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    states = [op for p in query.recentProgress for op in p.stateOperators]
    return Delivery(sum(int(op.customMetrics.get("numDroppedDuplicateRows", 0)) for op in states), sum(op.numRowsDroppedByWatermark for op in states))


def ingest_quotes(quotes: DataFrame, history: Callable[[], DataFrame], table: str, checkpoint: str, identity: Sequence[str] = (),
                  arrived: str | None = None, delay: str = "3 days") -> Delivery:
    """Average the new quotes per (ds, crop, state) and append the keys not seen before.

    ``quotes`` is a stream of cleaned quotes (cents); ``history`` gives the keys
    already stored elsewhere, best as a table partitioned by month.  Keys that any
    other batch of this table stored count too, whatever run it was.

    With ``identity`` (columns that name a quote) and ``arrived`` (when it was delivered) a quote that
    is sent again within ``delay`` counts once, also across batches and restarts: the ids of that time
    are kept in the checkpoint's state and leave it with the watermark.  The time is that of delivery, so
    old market days are never late; a row delivered more than ``delay`` behind the newest one is left out
    and counted in the result.
    """
    spark = quotes.sparkSession
    run = run_id(spark, checkpoint)
    if identity:
        quotes = quotes.withWatermark(arrived, delay).dropDuplicatesWithinWatermark([*identity])

    def write(batch: DataFrame, batch_id: int) -> None:
        daily = prices.daily_rollup(batch).persist()
        try:
            # Two dates come back; with them the stored files are pruned by their statistics.
            span = daily.agg(F.min("ds").alias("lo"), F.max("ds").alias("hi")).first()
            near = F.col("ds").between(F.lit(span["lo"]).cast("date"), F.lit(span["hi"]).cast("date"))
            stored = read_batches(spark, table, daily.schema, run, batch_id)
            fresh = prices.new_rows(history().select(*KEYS).unionByName(stored.select(*KEYS)).where(near), daily)
            fresh.write.mode("overwrite").parquet(batch_path(table, run, batch_id))
        finally:
            daily.unpersist()

    return _each_batch(quotes, write, checkpoint)


def ingest_articles(raw: DataFrame, run_ts: str, table: str, checkpoint: str, keep: Sequence[str] = ()) -> None:
    """Clean article payloads and append those whose id is not stored yet, however old the stored one is."""
    spark = raw.sparkSession
    run = run_id(spark, checkpoint)
    clean = news.clean_articles(raw, keep=list(keep)).withColumn("fetched_at", F.lit(run_ts).cast("timestamp"))

    def write(batch: DataFrame, batch_id: int) -> None:
        stored = read_batches(spark, table, batch.schema, run, batch_id).select("article_id")
        fresh = batch.dropDuplicates(["article_id"]).join(stored, "article_id", "left_anti").select(*batch.columns)
        fresh.write.mode("overwrite").parquet(batch_path(table, run, batch_id))

    _each_batch(clean, write, checkpoint)


def running_clusters(events: DataFrame, table: str, checkpoint: str, by: Sequence[str] = ("state", "crop", "direction"),
                     source: str = "source_name", window: str = "14 days") -> None:
    """Add each batch's events per tumbling window, key and source to the stored counts.

    Counts add up over batches, so windows show from their first event on, late
    events still count, and no state has to be kept; see ``read_clusters``.
    """
    run = run_id(events.sparkSession, checkpoint)

    def write(batch: DataFrame, batch_id: int) -> None:
        at = F.window(F.col("ts").cast("timestamp"), window)
        parts = batch.groupBy(at.alias("w"), *by, F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n"))
        parts.select(F.col("w.start").alias("window_start"), *by, "source", "n").write.mode("overwrite").parquet(batch_path(table, run, batch_id))

    _each_batch(events, write, checkpoint)


def read_clusters(spark: SparkSession, table: str, by: Sequence[str] = ("state", "crop", "direction")) -> DataFrame:
    """Events and different sources of every cluster so far, open windows included."""
    parts = spark.read.parquet(table).groupBy("window_start", *by, "source").agg(F.sum("n").alias("n"))
    n = F.count_if(F.col("source").isNotNull())
    return parts.groupBy("window_start", *by).agg(
        F.sum("n").alias("event_count"), n.alias("unique_sources"), F.when(n >= 2, "VERIFIED").otherwise("SINGLE_SOURCE").alias("verification_status"))


SKETCH_BITS = 12


def cluster_sketches(events: DataFrame, table: str, checkpoint: str, by: Sequence[str] = ("state", "crop", "direction"),
                     source: str = "source_name", window: str = "14 days", bits: int = SKETCH_BITS) -> None:
    """Store one row per tumbling window, key and batch: its events and a sketch of its different sources.

    For clusters with very many sources: what is stored and merged does not grow with them.
    Sketches of batches and runs merge, so open windows show and late events count.
    """
    run = run_id(events.sparkSession, checkpoint)

    def write(batch: DataFrame, batch_id: int) -> None:
        at = F.window(F.col("ts").cast("timestamp"), window)
        rows = batch.groupBy(at.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(source, bits).alias("sources"))
        rows.select(F.col("w.start").alias("window_start"), *by, "n", "sources").write.mode("overwrite").parquet(batch_path(table, run, batch_id))

    _each_batch(events, write, checkpoint)


def read_sketches(spark: SparkSession, table: str, by: Sequence[str] = ("state", "crop", "direction")) -> DataFrame:
    """Events and estimated different sources of every cluster so far, open windows included.

    The standard error is about 0.83 / sqrt(2^bits), 1.3 % with 12 bits; small numbers are exact.
    """
    merged = spark.read.parquet(table).groupBy("window_start", *by).agg(F.sum("n").alias("event_count"), F.hll_union_agg("sources").alias("s"))
    n = F.hll_sketch_estimate("s")
    return merged.select("window_start", *by, "event_count", n.alias("estimated_sources"), F.when(n >= 2, "VERIFIED").otherwise("SINGLE_SOURCE").alias("verification_status"))


LATEST_SCHEMA = "crop string, state string, ds date, market string, modal_cents bigint"
CHANGE_SCHEMA = f"{LATEST_SCHEMA}, change string"
#: Order in which a quote of a key is the later one.
NEWER = ["ds", "market", "modal_cents"]
#: Keyed state needs this store; and clock timers would ask for one empty batch after another, so they fire with the next data.
STATE_SETTINGS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
                  "spark.sql.streaming.noDataMicroBatches.enabled": "false"}


def newest_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of a task's quotes the newest of each key, so that a key with very many sends one row a task."""
    best = None
    for frame in frames:
        both = frame if best is None else pd.concat([best, frame])
        best = both.sort_values(NEWER, na_position="first").drop_duplicates(["crop", "state"], keep="last")
    if best is not None:
        yield best


class LatestPrice(StatefulProcessor):
    """Keeps the newest quote of a key until nothing confirms it for the time to live.

    A quote that is newer than the kept one is a change; one that is as new starts its time anew.
    """

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "ds date, market string, modal_cents bigint")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        old = self.latest.get()
        rank = lambda r: tuple((x is not None, x) for x in r)
        new = max(((r["ds"], r["market"], r["modal_cents"]) for r in rows), key=rank)
        if old is not None and rank(new) < rank(tuple(old)):
            return
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.ttl_ms)
        if old is None or rank(new) > rank(tuple(old)):
            self.latest.update(new)
            yield Row(crop=key[0], state=key[1], ds=new[0], market=new[1], modal_cents=new[2], change="UPDATED")

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        old = self.latest.get()
        self.latest.clear()
        if old is not None:
            yield Row(crop=key[0], state=key[1], ds=old[0], market=old[1], modal_cents=old[2], change="EXPIRED")

    def close(self) -> None:
        pass


def latest_prices(quotes: DataFrame, table: str, checkpoint: str, ttl_ms: int = 3 * 86_400_000) -> None:
    """Store every change of the latest quote of a (crop, state), and its expiry.

    The newest quote of a key is keyed state of the checkpoint with a timer: a key that no
    quote confirms for ``ttl_ms`` leaves the state with the next batch and an EXPIRED row tells so.  A batch
    writes only what changed, under its run and number; see ``read_latest``.  A key that
    comes back after its time, or under a new checkpoint, is a change again, which the
    reader sorts out.
    """
    spark = quotes.sparkSession
    run = run_id(spark, checkpoint)
    small = quotes.select("crop", "state", "ds", "market", "modal_cents").mapInPandas(newest_rows, LATEST_SCHEMA)
    changes = small.groupBy("crop", "state").transformWithState(LatestPrice(ttl_ms), CHANGE_SCHEMA, "Update", "ProcessingTime")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(batch_path(table, run, batch_id))

    kept = {name: spark.conf.get(name, None) for name in STATE_SETTINGS}
    for name, value in STATE_SETTINGS.items():
        spark.conf.set(name, value)
    try:
        _each_batch(changes, write, checkpoint, "update")
    finally:
        for name, value in kept.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def read_latest(spark: SparkSession, table: str, as_of: Column, ttl_days: int = 3) -> DataFrame:
    """Newest stored quote of each key with its age; past the limit it is marked expired, not dropped."""
    stored = read_batches(spark, table, StructType.fromDDL(CHANGE_SCHEMA)).where("change = 'UPDATED'")
    # The latest day of a key first, by plain numbers; then the largest row among that day's.
    days = stored.groupBy("crop", "state").agg(F.max("ds").alias("ds"))
    latest = stored.join(days, ["crop", "state", "ds"]).groupBy("crop", "state", "ds").agg(F.max(F.struct("market", "modal_cents")).alias("m"))
    age = F.greatest(F.datediff(as_of, "ds"), F.lit(0)).cast("bigint")
    return latest.select("crop", "state", "ds", F.col("m.market").alias("market"), N.rupees(F.col("m.modal_cents")).alias("price"), age.alias("data_age_days"),
                         (age >= ttl_days).alias("expired"))
