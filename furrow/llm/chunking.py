"""Repeated passages by content-defined chunking.

A gear hash rolls over the bytes of a text; a chunk ends where its top bits are zero,
so the same passage is cut in the same places wherever it stands, and an insertion moves
only the chunks it touches.  Chunks are counted by a 128-bit digest.  Neighbouring
chunks that several documents have form a passage; passages of at least ``MIN_CHARS``
characters are reported.  Every digest belongs to the document of the least id that has
it; the other occurrences are repeats.

A digest that very many documents share is one row a task after the map-side count.  The shared
digests are written out, so that the join back has a plain exchange on both sides, and Spark
splits the occurrences of a frequent digest over several tasks.

Defined cases: null and empty texts have no chunks; a null id counts as the least; repeated rows
(same id and text) count as one document; rows of one id with different texts are
told apart by a text hash; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import byte_steps, text_bytes
from furrow.session import cut_lineage

#: Zero bits that end a chunk: one byte in 2 to this many.
CUT_BITS = 4
#: Bytes of the shortest and of the longest chunk (but for a text's last, and a character that is not cut).
LEAST_BYTES, MOST_BYTES = 16, 512
#: Characters of the shortest passage that is reported, about 20 words.
MIN_CHARS = 120
#: Bytes that the gear hash remembers, and its bits: fewer, and the cuts of a passage are its own sooner after its start.
MEMORY = 16
GEAR = np.random.default_rng(909).integers(0, 1 << MEMORY, 256, dtype=np.uint16)
#: Place of a null id.
LOWEST = -(1 << 63)


def cut_marks(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Ascending ends of possible chunks: bytes after which the gear hash says cut, never inside a character.

    The hash is built for all bytes at once by doubling: of 1, 2, 4, 8, 16 bytes.  Texts
    stand ``MEMORY`` empty places apart, so none sees the one before it.
    """
    text = np.repeat(np.arange(1, len(bounds)), np.diff(bounds))
    at = np.arange(len(raw)) + MEMORY * text
    rolled = np.zeros(len(raw) + MEMORY * len(bounds), np.uint16)
    rolled[at] = GEAR[raw]
    step = 1
    while step < MEMORY:
        longer = rolled.copy()
        longer[step:] += rolled[:-step] << np.uint16(step)
        rolled, step = longer, step * 2
    ends = np.flatnonzero(rolled[at] >> np.uint16(MEMORY - CUT_BITS) == 0) + 1
    return ends[(ends == len(raw)) | ((raw[np.minimum(ends, len(raw) - 1)] & 0xC0) != 0x80)]


def chunk_ends(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of all chunks of all texts, and each chunk's text number."""
    marks = cut_marks(raw, bounds)
    places = np.searchsorted(marks, bounds)
    marks = marks.tolist()
    ends: list[int] = []
    counts = []
    for k, (start, stop) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        before = len(ends)
        for mark in marks[places[k] : places[k + 1]]:
            while mark - start > MOST_BYTES:
                start = character_end(raw, start + MOST_BYTES, stop)
                ends.append(start)
            if mark - start >= LEAST_BYTES:
                ends.append(mark)
                start = mark
        while stop - start > MOST_BYTES:
            start = character_end(raw, start + MOST_BYTES, stop)
            ends.append(start)
        if stop > start:
            ends.append(stop)
        counts.append(len(ends) - before)
    return np.array(ends, np.int64), np.repeat(np.arange(len(counts)), counts)


def character_end(raw: np.ndarray, at: int, stop: int) -> int:
    """The first place from ``at`` on where no character is cut."""
    while at < stop and raw[at] & 0xC0 == 0x80:
        at += 1
    return at


def chunks(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, start and stop (code points), and the two halves of the digest of every chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in byte_steps(batches):
            raw, bounds = text_bytes(piece.column("text"))
            if not len(raw):
                continue
            ends, text = chunk_ends(raw, bounds)
            starts = np.concatenate(([0], ends[:-1]))
            starts = np.maximum(starts, bounds[text])
            whole = raw.tobytes()
            digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(whole[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)), "<i8").reshape(-1, 2)
            points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
            base = points[bounds[text]]
            own = pa.array(text)
            yield pa.RecordBatch.from_pydict({
                "place": piece.column("place").take(own), "text_hash": piece.column("text_hash").take(own), "start": (points[starts] - base).astype(np.int32), "stop": (points[ends] - base).astype(np.int32),
                "high": np.ascontiguousarray(digest[:, 0]), "low": np.ascontiguousarray(digest[:, 1])})

    slim = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("place"), F.xxhash64("text").alias("text_hash"), "text")
    return slim.mapInArrow(run, "place long, text_hash long, start int, stop int, high long, low long")


def passages(starts: np.ndarray, stops: np.ndarray, firsts: np.ndarray, place: int, repeated_here: np.ndarray) -> list[tuple[int, int, int, bool]]:
    """Merge a document's repeated chunks: (start, stop, least document, is a repeat), in order.

    Chunks that touch are one passage, long enough or not as a whole; it is reported
    in parts that are alike in being kept or a repeat.
    """
    fresh = np.concatenate(([True], starts[1:] != stops[:-1]))
    length = np.bincount(np.cumsum(fresh) - 1, stops - starts)[np.cumsum(fresh) - 1]
    keep = length >= MIN_CHARS
    starts, stops, firsts, repeated_here = starts[keep], stops[keep], firsts[keep], repeated_here[keep]
    out: list[list] = []
    for s, e, f, again in zip(starts.tolist(), stops.tolist(), firsts.tolist(), repeated_here.tolist(), strict=True):
        repeat = f != place or again
        if out and out[-1][1] == s and out[-1][3] == repeat:
            out[-1][1] = e
            out[-1][2] = min(out[-1][2], f)
        else:
            out.append([s, e, f, repeat])
    return [tuple(x) for x in out]


def repeated_passages(docs: DataFrame, across: bool = True) -> DataFrame:
    """doc_id, text_hash, start, stop, first_doc_id, action of every passage that occurs in more than one document.

    Without ``across``, passages that one document alone repeats count as well.

    Positions are code points, the stop exclusive.  ``action`` is ``keep`` in the
    document of the least id and ``remove`` in all others, and for a document's own repeats.
    """
    found = chunks(docs)
    owner = F.xxhash64("place", "text_hash") if across else F.xxhash64("place", "text_hash", "start")
    shared = cut_lineage(found.groupBy("high", "low").agg(F.min("place").alias("first"), F.min(owner).alias("a"), F.max(owner).alias("b")).filter("a <> b").drop("a", "b"), "shared")
    # A merge join at every size: the join that adaptive execution splits.
    own = (found.join(shared.hint("merge"), ["high", "low"]).groupBy("place", "text_hash")
           .agg(F.collect_set(F.struct("start", "stop", "first", "high", "low")).alias("parts")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column("parts")
            flat, bounds = parts.flatten(), parts.offsets.to_numpy() - parts.offsets[0].as_py()
            columns = [flat.field(k).to_numpy(zero_copy_only=False) for k in range(5)]
            rows = []
            for k, (place, text_hash) in enumerate(zip(batch.column("place").to_pylist(), batch.column("text_hash").to_pylist(), strict=True)):
                start, stop, first, high, low = (c[bounds[k] : bounds[k + 1]] for c in columns)
                order = np.argsort(start, kind="stable")
                start, stop, first, high, low = (c[order] for c in (start, stop, first, high, low))
                by_digest = np.lexsort((start, low, high))
                again = np.zeros(len(start), bool)
                again[by_digest[1:]] = (high[by_digest[1:]] == high[by_digest[:-1]]) & (low[by_digest[1:]] == low[by_digest[:-1]])
                rows += [(None if place == LOWEST else place, text_hash, s, e, None if f == LOWEST else f, "remove" if r else "keep") for s, e, f, r in passages(start, stop, first, place, again)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string()), strict=True)],
                                                 ["doc_id", "text_hash", "start", "stop", "first_doc_id", "action"])

    return own.mapInArrow(run, "doc_id long, text_hash long, start int, stop int, first_doc_id long, action string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with every passage to remove cut out of ``text``; all other columns and all rows stay."""
    cuts = (repeated_passages(docs).filter("action = 'remove'").groupBy(F.col("doc_id").alias("cut_id"), F.col("text_hash").alias("cut_hash"))
            .agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("cuts")))
    # The document's row is one struct, so that no name of its columns can clash.
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    text = F.col("doc")["text"]
    joined = packed.join(cuts, F.col("doc")["doc_id"].cast("long").eqNullSafe(cuts["cut_id"]) & (F.xxhash64(text) == cuts["cut_hash"]), "left")
    edges = F.concat(F.array(F.lit(0)), F.flatten(F.transform("cuts", lambda c: F.array(c["start"], c["stop"]))), F.array(F.length(text)))
    kept = F.transform(F.sequence(F.lit(0), F.size("cuts")), lambda k: F.substring(text, F.element_at(edges, k * 2 + 1) + 1, F.element_at(edges, k * 2 + 2) - F.element_at(edges, k * 2 + 1)))
    whole = F.when(F.col("cuts").isNull(), text).otherwise(F.array_join(kept, "")).alias("text")
    return joined.select(*[whole if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns])
