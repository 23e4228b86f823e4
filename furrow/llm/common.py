"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.session import remove_path, shared_folder

#: Text bytes that one numpy step works on; a longer text is a step of its own.
STEP_BYTES = 1 << 20


#: Rows of an Arrow batch.  Texts are long, and a batch is held by the executor and by its Python worker at once.
BATCH_ROWS = 500


def bounded_batches(spark: SparkSession) -> None:
    """Let no Arrow batch of the session hold more than ``BATCH_ROWS`` rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables, in a session with bounded Arrow batches."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder.

    Sessions of ``build_session`` delete the files when nothing refers to them; elsewhere they
    stay until ``forget`` or the folder's owner removes them.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def forget(df: DataFrame) -> None:
    """Delete the files of a checkpointed frame, once nothing will read it again."""
    file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        remove_path(df.sparkSession, file.get())


def unused(columns: list[str], name: str) -> str:
    """``name``, with as many underscores after it as make it differ from all columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def byte_steps(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each piece holds at most ``STEP_BYTES`` of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(text_lengths(batch.column(column)))
        start, done = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, done + STEP_BYTES, side="right")))
            yield batch.slice(start, stop - start)
            start, done = stop, int(ends[stop - 1])


def text_lengths(texts: pa.Array) -> np.ndarray:
    """Bytes of each text, 0 for null."""
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a piece end to end, and the n + 1 bounds of its texts (null counts as empty)."""
    whole = (pc.fill_null(texts, "") if texts.null_count else texts).cast(pa.large_string())
    offsets = np.frombuffer(whole.buffers()[1], dtype=np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = whole.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def with_columns(batch: pa.RecordBatch, names: list[str], **new: pa.Array) -> pa.RecordBatch:
    """The named columns of a piece followed by new ones."""
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *new.values()], [*names, *new])


def connected_components(edges: DataFrame) -> DataFrame:
    """Least reachable node of every node of an undirected graph.

    ``edges`` has numeric columns ``a`` and ``b``; the result has one row
    (``node``, ``component``) per node that occurs.  Large-star and small-star
    rounds, each one minimum per node (combined before the shuffle) and an equi
    join back, so that a node with very many neighbours is never gathered.
    A round ends in a checkpoint; the rounds grow with the logarithm of the
    longest path.
    """
    both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    state = checkpointed(both)
    seen = None
    while True:
        mark = state.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if seen == (mark["n"], mark["h"]):
            break
        seen = (mark["n"], mark["h"])
        # Large star: neighbours above a node go to the least of the node and all its neighbours.
        ways = state.union(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ways.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = ways.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: a node and its smaller neighbours go to the least of these.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        before, state = state, checkpointed(small.select("e.u", "e.v").filter("u <> v").distinct())
        forget(before)
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        state.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
