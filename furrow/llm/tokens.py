"""Token ids in seekable zstandard files: independent frames, a trailing seek table, checksums.

A file is a row of zstandard frames that can each be decompressed alone, then two
skippable frames that ordinary decoders pass over: the document index (ids and
lengths of the documents in order) and, last, the seek table (compressed size,
size and XXH64 checksum of every frame).  A reader opens a file from its end and
decompresses only the frames that hold the documents asked for.

Documents are dealt to files by ranges of ids, so file order is id order.  A task
writes its file under a name of its own attempt and reports it in the manifest that
Spark commits; files of lost or repeated attempts are in no manifest and are
removed after the write.

Defined cases: a null text is empty and holds the end id alone; null ids come
first; rows with equal ids keep the order of their texts; an empty table makes a
manifest without files; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from furrow.llm.common import byte_steps

# Fixed values of the public zstandard seekable format.
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_SEEK = 0x184D2A5E
SEEK_MAGIC = 0x8F92EAB1

#: Ids in a frame before it is closed; a longer document fills a frame of its own.
FRAME_IDS = 1 << 16
LEVEL = 3
#: Words whose ids a task remembers before it starts afresh.
REMEMBERED_WORDS = 300_000

#: Letters that lower-casing and normalizing keep single, then ASCII punctuation.
LETTERS_THEN_MARKS = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\\[-`{-~]*)")
PLAIN_LETTERS = re.compile("[a-zß-öø-ÿ]+")
#: The byte-level alphabet's spelling of these letters: bytes that are printable Latin-1 stand for themselves, the others
#: for the characters from 256 on in the order of the bytes.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
SPELLED = {b: chr(b) for b in PRINTABLE} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in PRINTABLE)}
BYTE_LETTERS = {c: "".join(SPELLED[b] for b in chr(c).encode()) for c in range(0xDF, 0x100) if chr(c).isalpha()}

MANIFEST = "file string, number int, docs long, ids long, bytes long"


class WordEncoder:
    """Ids of texts by words, each different word encoded once.

    Holds for tokenizers that never join what white space parts, and that part letters from
    punctuation, as the fixed vocabulary's pre-tokenizer does; ``tests`` compare it with
    whole-text encoding.  A new word of letters and punctuation is put together from
    the ids of its lower-case letters and of its punctuation, which repeat more often than it does.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.parts: dict[str, bytes] = {}
        self.forget()

    def forget(self) -> None:
        """Drop the remembered words; those of one task's documents save nearly all work that remembering more would."""
        self.place: dict[str, int] = {}
        self.ids = np.zeros(0, np.uint32)
        self.bounds = np.zeros(1, np.int64)

    def finish(self) -> None:
        """End of a task: a Python worker lives on, and what it holds would count against the stages after this one."""
        self.forget()
        self.parts = {}
        pa.default_memory_pool().release_unused()

    def part(self, text: str) -> bytes:
        """Ids of a word's part, 4 bytes each.  Plain lower-case letters need no more than the tokenizer's model."""
        if text.isascii() and text.isalpha() and text.islower():
            return array("I", [t.id for t in self.model.tokenize(text)]).tobytes()
        if PLAIN_LETTERS.fullmatch(text):
            return array("I", [t.id for t in self.model.tokenize(text.translate(BYTE_LETTERS))]).tobytes()
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def new_words(self, words: list[str]) -> list[bytes]:
        if len(self.parts) > REMEMBERED_WORDS:
            self.parts = {}
        known, out, part = self.parts, [], self.part
        for word in words:
            if word.isascii() and word.isalpha():
                letters, marks = word.lower(), ""
            else:
                match = LETTERS_THEN_MARKS.fullmatch(word)
                letters, marks = (match[1].lower(), match[2]) if match else (word, "")
            ids = known.get(letters)
            if ids is None:
                ids = known[letters] = part(letters)
            if marks:
                more = known.get(marks)
                if more is None:
                    more = known[marks] = part(marks)
                ids += more
            out.append(ids)
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the n + 1 bounds.  Null counts as empty."""
        if len(self.place) > REMEMBERED_WORDS:
            self.forget()
        # Words between ASCII white space; the empty ones at a text's ends go.
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        flat = lists.flatten()
        solid = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
        words = flat.filter(pa.array(solid)).dictionary_encode()
        known, different = self.place, words.dictionary.to_pylist()
        at = np.fromiter(map(known.get, different, repeat(-1)), np.int64, len(different))
        missing = np.flatnonzero(at < 0).tolist()
        if missing:
            new = [different[i] for i in missing]
            found = self.new_words(new)
            at[missing] = np.arange(len(known), len(known) + len(new))
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
            self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(found), np.uint32)])
            self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(lengths)])
        at = at[words.indices.to_numpy()]
        start, size = self.bounds[at], self.bounds[at + 1] - self.bounds[at]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.arange(total) + np.repeat(start - (ends - size), size)]
        last = np.concatenate(([0], np.cumsum(solid)))[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        return ids, np.concatenate(([0], ends))[last]


@lru_cache(maxsize=1)
def encoder_of(path: str) -> WordEncoder:
    """The encoder of this Python worker: the vocabulary is read once."""
    return WordEncoder(path)


class FrameWriter:
    """One file in the making."""

    def __init__(self, sink) -> None:
        self.sink, self.zstd = sink, zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
        self.frames: list[tuple[int, int, int]] = []
        self.doc_ids: list[int | None] = []
        self.counts: list[int] = []
        self.held: list[bytes] = []
        self.held_ids = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """Append a document's ids, 4 bytes each in little-endian order."""
        count = len(ids) // 4
        if self.held_ids and self.held_ids + count > FRAME_IDS:
            self.close_frame()
        self.doc_ids.append(doc_id)
        self.counts.append(count)
        self.held.append(ids)
        self.held_ids += count

    def close_frame(self) -> None:
        raw = b"".join(self.held)
        if raw:
            packed = self.zstd.compress(raw)
            self.sink.write(packed)
            self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.held, self.held_ids = [], 0

    def finish(self) -> None:
        self.close_frame()
        known = np.array([i is not None for i in self.doc_ids], dtype="u1")
        index = struct.pack("<Q", len(known)) + known.tobytes() + np.array([i or 0 for i in self.doc_ids], "<i8").tobytes() + np.array(self.counts, "<u4").tobytes()
        packed = self.zstd.compress(index)
        self.sink.write(struct.pack("<II", SKIPPABLE_INDEX, len(packed)) + packed)
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0x80, SEEK_MAGIC)
        # The index length lets a reader find the index from the end, too.
        self.sink.write(struct.pack("<II", SKIPPABLE_SEEK, len(table)) + table)


@dataclass
class TokenFile:
    """A finished file, read from its end."""

    source: pafs.FileSystem
    path: str

    def __post_init__(self) -> None:
        self.stream = self.source.open_input_file(self.path)
        size = self.stream.size()
        frames, flags, magic = struct.unpack("<IBI", self.stream.read_at(9, size - 9))
        if magic != SEEK_MAGIC or flags != 0x80:
            raise ValueError(f"{self.path} has no seek table")
        start = size - 9 - 12 * frames
        self.frames = np.frombuffer(self.stream.read_at(12 * frames, start), "<u4").reshape(-1, 3).astype(np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.frames[:, 0])))
        at = int(self.starts[-1])
        magic, length = struct.unpack("<II", self.stream.read_at(8, at))
        if magic != SKIPPABLE_INDEX or at + 16 + length != start:
            raise ValueError(f"{self.path} has no document index")
        index = zstandard.ZstdDecompressor().decompress(self.stream.read_at(length, at + 8))
        n = struct.unpack("<Q", index[:8])[0]
        known = np.frombuffer(index, "u1", n, 8).astype(bool)
        ids = np.frombuffer(index, "<i8", n, 8 + n)
        self.doc_ids = pa.array(ids, mask=~known)
        self.counts = np.frombuffer(index, "<u4", n, 8 + 9 * n).astype(np.int64)
        self.bounds = np.concatenate(([0], np.cumsum(self.counts)))
        self.frame_ends = np.cumsum(self.frames[:, 1]) // 4

    def frame(self, k: int) -> np.ndarray:
        """The ids of one frame, its checksum verified."""
        raw = zstandard.ZstdDecompressor().decompress(self.stream.read_at(int(self.frames[k, 0]), int(self.starts[k])), max_output_size=int(self.frames[k, 1]))
        if len(raw) != self.frames[k, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.frames[k, 2]:
            raise ValueError(f"{self.path}: frame {k} is damaged")
        return np.frombuffer(raw, "<u4")

    def documents(self, wanted: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(position, ids) of the wanted positions in ascending order, all if None; no other frame is touched."""
        held, ids = -1, np.zeros(0, "<u4")
        for i in range(len(self.counts)) if wanted is None else np.sort(wanted).tolist():
            k = int(np.searchsorted(self.frame_ends, self.bounds[i], side="right"))
            if k != held:
                held, ids = k, self.frame(k)
            start = int(self.bounds[i]) - (int(self.frame_ends[k - 1]) if k else 0)
            yield i, ids[start : start + int(self.counts[i])]


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system of a folder that all executors share (local, HDFS, S3, GCS), and the path on it."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri) if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_tokens(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 2, files: int | None = None) -> DataFrame:
    """Encode all documents into files below ``folder``; the manifest, one row per file in id order.

    ``files`` is the number of files, as many as shuffle partitions if None.
    """
    session = docs.sparkSession
    files = files or int(session.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number, name = context.partitionId(), f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}.zst"
        store, base = filesystem(folder)
        writer, encoder = None, encoder_of(vocabulary)
        for piece in byte_steps(batches):
            if writer is None:
                sink = store.open_output_stream(f"{base}/{name}", compression=None)
                writer = FrameWriter(sink)
            ids, bounds = encoder.encode(piece.column("text"))
            raw = np.insert(ids, bounds[1:], np.uint32(end_id)).astype("<u4").tobytes()
            ends = (bounds + np.arange(len(bounds))).tolist()
            for k, doc_id in enumerate(piece.column("doc_id").to_pylist()):
                writer.add(doc_id, raw[4 * ends[k] : 4 * ends[k + 1]])
        encoder.finish()
        if writer is not None:
            writer.finish()
            size = sink.tell()
            sink.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "number": pa.array([number], pa.int32()), "docs": [len(writer.counts)], "ids": [int(sum(writer.counts))], "bytes": [size]})

    store, base = filesystem(folder)
    store.create_dir(base, recursive=True)
    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(files, "doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    ordered.mapInArrow(run, MANIFEST).write.mode("errorifexists").parquet(f"{folder}/manifest")
    manifest = session.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    named = {r["file"] for r in manifest.select("file").toLocalIterator()}  # one name per file
    for found in store.get_file_info(pafs.FileSelector(base)):
        if found.type == pafs.FileType.File and found.base_name.endswith(".zst") and found.base_name not in named:
            store.delete_file(found.path)
    return manifest


def one_task_a_file(manifest: DataFrame) -> DataFrame:
    """The manifest's rows dealt to as many tasks as there are files; a range of numbers with a count is not merged again."""
    return manifest.repartitionByRange(max(1, manifest.count()), "number")


def read_tokens(session: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files below ``folder``.

    ``start`` counts the ids of all documents before it in id order.
    """
    manifest = session.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    before = F.coalesce(F.sum("ids").over(Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = one_task_a_file(manifest.withColumn("before", before).select("number", "file", "before", "ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = filesystem(folder)
        for batch in batches:
            for row in batch.to_pylist():
                file = TokenFile(store, f"{base}/{row['file']}")
                if int(file.counts.sum()) != row["ids"]:
                    raise ValueError(f"{row['file']} does not hold what the manifest says")
                crc = [zlib.crc32(ids.tobytes()) for _, ids in file.documents()]
                yield pa.RecordBatch.from_pydict({"doc_id": file.doc_ids, "start": row["before"] + file.bounds[:-1], "n_tokens": file.counts, "ids_crc32": pa.array(crc, pa.int64())})

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(session: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """(doc_id, ids) of the documents named by ``wanted`` (doc_id); only their frames are decompressed."""
    manifest = session.read.schema(MANIFEST).parquet(f"{folder}/manifest").select("number", "file")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = filesystem(folder)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                file = TokenFile(store, f"{base}/{name}")
                yield pa.RecordBatch.from_pydict({"file": [name] * len(file.counts), "position": np.arange(len(file.counts)), "doc_id": file.doc_ids})

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = filesystem(folder)
        for batch in batches:
            for row in batch.to_pylist():
                file = TokenFile(store, f"{base}/{row['file']}")
                for i, ids in file.documents(np.array(row["positions"])):
                    yield pa.RecordBatch.from_pydict({"doc_id": file.doc_ids.slice(i, 1), "ids": pa.array([ids.tolist()], pa.list_(pa.int64()))})

    places = one_task_a_file(manifest).mapInArrow(index, "file string, position long, doc_id long")
    asked = places.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("file").agg(F.collect_list("position").alias("positions"))
    return asked.mapInArrow(fetch, "doc_id long, ids array<long>")
