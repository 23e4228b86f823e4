"""Benchmark decontamination by greedy string tiling.

Texts are word sequences (ASCII letters and digits, any longer characters; A-Z as a-z;
everything else parts words).  The Karp-Rabin fingerprints of all windows of
``MIN_MATCH`` words are the seeds; a join on them finds the pairs of document and item that share
one.  In each pair the longest match of words not yet marked is marked again and
again until none of ``MIN_MATCH`` words is left.  Matches are read off the shared seeds: seeds
that follow each other on one diagonal are one match, and marking splits those it
cuts.  A document is contaminated by an item whose words are covered by tiles to at
least ``COVERAGE``, in whatever order the passages stand.

Windows of documents first meet a bitmap of the items' seeds, whose size is fixed whatever
the benchmark's, so only windows that may match are shuffled; the join then decides.

Defined cases: null and blank texts have no windows; an item of fewer than ``MIN_MATCH``
words cannot be matched; repeated rows (same id and text) are reported once, rows of one
id with different texts each; repeated items each; null ids are kept; empty tables give
an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm import hashing
from furrow.llm.common import byte_steps, checkpointed, text_bytes

#: Words of the shortest match.
MIN_MATCH = 5
#: Share of an item's words that tiles must cover.
COVERAGE = 0.5
#: The bitmap has 2 to this many bits (2 MB).
FILTER_BITS = 24
#: Contaminated documents up to which their keys are broadcast; beyond it the join is left to Spark.
BROADCAST_ROWS = 1_000_000

PLAIN = np.arange(256, dtype=np.uint8)
PLAIN[[i for i in range(128) if not chr(i).isalnum()]] = 32


def windows(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprint, text number and word position of all windows of ``size`` words, and the words of each text."""
    raw, bounds = text_bytes(texts)
    words, _, ends = hashing.word_hashes(PLAIN[raw], bounds)
    count = np.diff(ends)
    found, runs = hashing.shingles(words, ends, size)
    text = np.repeat(np.arange(len(count)), np.diff(runs))
    full = count[text] >= size
    return found[full], text[full], (np.arange(len(found)) - runs[:-1][text])[full], count


def tile(doc_at: np.ndarray, item_at: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """Tiles (document word, item word, length) of one pair, from the positions of their shared seeds."""
    diagonal = doc_at - item_at
    order = np.lexsort((doc_at, diagonal))
    doc_at, item_at, diagonal = doc_at[order], item_at[order], diagonal[order]
    fresh = np.concatenate(([True], (np.diff(diagonal) != 0) | (np.diff(doc_at) > 1)))
    first = np.flatnonzero(fresh)
    length = doc_at[np.append(first[1:], len(doc_at)) - 1] - doc_at[first] + size
    waiting = [(-int(n), int(d), int(i)) for n, d, i in zip(length, doc_at[first], item_at[first], strict=True)]
    heapq.heapify(waiting)
    doc_base, item_base = int(doc_at.min()), int(item_at.min())
    doc_free = np.ones(int((doc_at.max()) - doc_base) + size, bool)
    item_free = np.ones(int(item_at.max()) - item_base + size, bool)
    tiles = []
    while waiting:
        n, d, i = heapq.heappop(waiting)
        free = doc_free[d - doc_base : d - doc_base - n] & item_free[i - item_base : i - item_base - n]
        if free.all():
            doc_free[d - doc_base : d - doc_base - n] = False
            item_free[i - item_base : i - item_base - n] = False
            tiles.append((d, i, -n))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate(([False], free, [False])).astype(np.int8)))
        for start, stop in zip(edges[0::2].tolist(), edges[1::2].tolist(), strict=True):
            if stop - start >= size:
                heapq.heappush(waiting, (start - stop, d + start, i + start))
    return tiles


def item_seeds(benchmark: DataFrame, size: int) -> DataFrame:
    """seed, item_id, item_at, item_words of all windows of the items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in byte_steps(batches):
            found, text, at, count = windows(piece.column("text"), size)
            yield pa.RecordBatch.from_pydict({"seed": found.view(np.int64), "item_id": piece.column("item_id").take(pa.array(text)), "item_at": at.astype(np.int32), "item_words": count[text].astype(np.int32)})

    slim = benchmark.select("item_id", "text")
    return slim.mapInArrow(run, f"seed long, item_id {slim.schema['item_id'].dataType.simpleString()}, item_at int, item_words int")


def seed_filter(seeds: DataFrame) -> np.ndarray:
    """Bitmap of the seeds' top bits as 64-bit words."""
    top = F.shiftrightunsigned("seed", 64 - FILTER_BITS)
    rows = seeds.select(F.shiftright(top, 6).alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(seed, {64 - FILTER_BITS}) & 63 AS INT))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    bitmap = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    bitmap[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return bitmap.view(np.uint64)


def shared_seeds(docs: DataFrame, bitmap: np.ndarray, size: int) -> DataFrame:
    """doc_id, text_hash, seed, doc_at of the documents' windows that the bitmap lets pass."""
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)  # 2 MB whatever the tables

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for piece in byte_steps(batches):
            found, text, at, _ = windows(piece.column("text"), size)
            top = found >> np.uint64(64 - FILTER_BITS)
            hit = np.flatnonzero(known[(top >> np.uint64(6)).astype(np.int64)] >> (top & np.uint64(63)) & np.uint64(1))
            own = pa.array(text[hit])
            yield pa.RecordBatch.from_pydict({"doc_id": piece.column("doc_id").take(own), "text_hash": piece.column("text_hash").take(own), "seed": found[hit].view(np.int64), "doc_at": at[hit].astype(np.int32)})

    slim = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, text_hash long, seed long, doc_at int")


def contamination(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, size: int = MIN_MATCH) -> DataFrame:
    """doc_id, text_hash, item_id, tiles, covered, item_words, coverage of every contaminated pair."""
    seeds = checkpointed(item_seeds(benchmark, size))
    hits = shared_seeds(docs, seed_filter(seeds), size).join(seeds, "seed")
    pairs = hits.groupBy("doc_id", "text_hash", "item_id", "item_words").agg(F.collect_set(F.struct("doc_at", "item_at")).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("at")
            flat, bounds = at.flatten(), at.offsets.to_numpy() - at.offsets[0].as_py()
            doc_at, item_at = (flat.field(k).to_numpy().astype(np.int64) for k in (0, 1))
            found = [tile(doc_at[s:e], item_at[s:e], size) for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
            covered = np.array([sum(n for *_, n in t) for t in found], np.int64)
            words = batch.column("item_words").to_numpy().astype(np.int64)
            keep = pa.array(covered >= coverage * words)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"), "item_id": batch.column("item_id"), "tiles": pa.array([len(t) for t in found], pa.int32()),
                "covered": covered, "item_words": words, "coverage": covered / words}).filter(keep)

    kinds = {c: hits.schema[c].dataType.simpleString() for c in ("doc_id", "item_id")}
    return pairs.mapInArrow(run, f"doc_id {kinds['doc_id']}, text_hash long, item_id {kinds['item_id']}, tiles int, covered long, item_words long, coverage double")


def clean_documents(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, size: int = MIN_MATCH) -> DataFrame:
    """The documents that no item contaminates, with the columns of ``docs``."""
    found = checkpointed(contamination(docs, benchmark, coverage, size).select(F.col("doc_id").alias("leak_id"), F.col("text_hash").alias("leak_hash")).distinct())
    found = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
    return docs.join(found, docs["doc_id"].eqNullSafe(found["leak_id"]) & (F.xxhash64(docs["text"]) == found["leak_hash"]), "left_anti")
