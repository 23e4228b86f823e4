"""MinHash fingerprints over word shingles, and near duplicates by signature bands.

A fingerprint holds ``PERMUTATIONS`` components; each is the low half of the least value that
one universal hash permutation (a x + b modulo 2 to the 32, a odd) gives any
five-word shingle of the text.  The share of equal components estimates the Jaccard
similarity of the shingle sets.  Near duplicates share a band of components; every
such candidate is verified on the shingle sets themselves.

Words are parted by ASCII white space, A-Z count as a-z.  Defined cases: a null text is
empty; a text without words has a fingerprint of zeros, alike only to itself; a shorter text is
one shingle of all its words; null ids come first in id order and rows of one id
in the order of their texts; repeated rows give one result row each; a single
document is its own successor; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.llm import hashing
from furrow.llm.common import byte_steps, checkpointed, connected_components, text_bytes
from furrow.llm.simhash import BLOCK_ROWS, BLOCK_SHINGLES, Sets, grouped, united

PERMUTATIONS = 128
WORDS = 5
#: Components of a band; 128 components make 32 bands of 4, which a pair of similarity 0.8 shares with probability over 0.9999.
BAND_ROWS = 4
_RANDOM = np.random.default_rng(71)
FACTORS = (_RANDOM.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32) | np.uint32(1))[:, None]
SHIFTS = _RANDOM.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32)[:, None]
NOTHING = np.uint32(0xFFFFFFFF)
#: Place of a null id in id order.
LOWEST = -(1 << 63)
#: Shingles permuted in one numpy step.
STEP = 4096


def least_values(shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Least permuted value (row per text) of every permutation; ``NOTHING`` without shingles."""
    out = np.full((len(bounds) - 1, PERMUTATIONS), NOTHING, np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)[None, :]
    for at in range(0, len(shingles), STEP):
        stop = min(at + STEP, len(shingles))
        first, last = np.searchsorted(bounds, at, side="right") - 1, np.searchsorted(bounds, stop, side="left")
        texts = np.arange(first, last)
        texts = texts[bounds[texts + 1] > bounds[texts]]
        least = np.minimum.reduceat(x[:, at:stop] * FACTORS + SHIFTS, np.maximum(bounds[texts] - at, 0), axis=1)
        out[texts] = np.minimum(out[texts], least.T)
    return out


def components(least: np.ndarray, empty: np.ndarray) -> np.ndarray:
    """Fingerprint components of 16 bits, zero for texts without words."""
    low = (least & np.uint32(0xFFFF)).astype(">u2")
    low[empty] = 0
    return low


def fingerprint_text(component: np.ndarray) -> str:
    """Four hex digits for each component."""
    return component.tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, a_empty: bool, b_empty: bool) -> float:
    """Share of equal components; a text without words is like another such text only."""
    return float(a_empty == b_empty) if a_empty or b_empty else float(np.mean(a == b))


class Prints:
    """Shingle minima of many texts, each in two parts: shingles whole within a prefix, and the rest."""

    def __init__(self, texts: list[str], prefix: list[int] | None = None) -> None:
        raw, bounds = text_bytes(pa.array(texts, pa.string()))
        words, starts, ends = hashing.word_hashes(raw, bounds)
        shingles, runs = hashing.shingles(words, ends, WORDS)
        self.count = np.diff(ends)
        self.empty = self.count == 0
        if prefix is None:
            self.least = least_values(shingles, runs)
            return
        # Words that a change of what follows the prefix cannot touch: those with a blank between them and its end.
        cut = bounds[:-1] + np.array(prefix, np.int64)
        kept = np.maximum(np.searchsorted(starts, cut) - ends[:-1] - 1, 0)
        self.kept_bytes = [int(starts[e + k - WORDS + 1] - b) if k >= WORDS else 0 for b, e, k in zip(bounds[:-1], ends[:-1], kept, strict=True)]
        common = np.where(np.diff(ends) > WORDS, np.maximum(kept - WORDS + 1, 0), 0)
        parts = np.column_stack([runs[:-1], runs[:-1] + common]).ravel()
        both = least_values(shingles, np.append(parts, runs[-1]))
        self.kept = both[0::2]
        self.kept[common == 0] = NOTHING
        self.kept_bytes = [b if c else 0 for b, c in zip(self.kept_bytes, common, strict=True)]
        self.least = np.minimum(self.kept, both[1::2])


def edit(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by as much of the start of ``following``."""
    tail = len(text) // 4
    return text[: len(text) - tail] + following[:tail]


def compared(docs: list[tuple[int | None, str]], following: list[tuple[int | None, str]]) -> Iterator[dict]:
    """Result rows of documents, each with the one after it."""
    own, texts = [t for _, t in docs], [t for _, t in following]
    prefix = [len(t[: len(t) - len(t) // 4].encode()) for t in own]
    now = Prints(own, prefix)
    after = Prints(texts[-1:])
    edited = [edit(t, n) for t, n in zip(own, texts, strict=True)]
    # An edited text keeps the shingles of its prefix; only what follows them is hashed again.
    rest = Prints([e.encode()[k:].decode() for e, k in zip(edited, now.kept_bytes, strict=True)])
    short = (rest.count < WORDS) & (np.array(now.kept_bytes) > 0)  # fewer words than a shingle, of a text that has more
    changed = np.where(short[:, None], now.kept, np.minimum(now.kept, rest.least))
    mine = components(now.least, now.empty)
    other = np.concatenate([mine[1:], components(after.least, after.empty)])
    other_empty = np.append(now.empty[1:], after.empty)
    blank = np.array([not e.strip(" \t\n\r\x0b\x0c") for e in edited])
    new = components(changed, blank)
    for k, (doc_id, text) in enumerate(docs):
        yield {"doc_id": doc_id, "n_chars": len(text), "edited_sha256": hashlib.sha256(edited[k].encode()).hexdigest(),
               "fingerprint": fingerprint_text(mine[k]), "edited_fingerprint": fingerprint_text(new[k]),
               "near_edited": likeness(mine[k], new[k], now.empty[k], blank[k]), "near_next": likeness(mine[k], other[k], now.empty[k], other_empty[k])}


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def ranges(ids: DataFrame, pieces: int) -> list[int]:
    """Ids that part the documents into about ``pieces`` ranges of like size."""
    shares = [k / pieces for k in range(1, pieces)]
    found = ids.agg(F.percentile_approx("doc_id", shares, max(10_000, 5 * pieces)).alias("at")).first()["at"] if shares else None
    return sorted(set(found or []))


def compare_with_next(docs: DataFrame, pieces: int | None = None) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness; see ``RESULT``.

    Documents are dealt to ranges of ids and pass through each in order.  A range ends with a copy of the
    first document of the next, so no task sees more than its range and that one.
    """
    session = docs.sparkSession
    pieces = pieces or int(session.conf.get("spark.sql.shuffle.partitions")) * 8
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("place"))
    bounds = np.array(ranges(slim.select("doc_id"), pieces), np.int64)

    @F.pandas_udf("int")
    def range_of(place: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, place.to_numpy(), side="right").astype(np.int32))

    ranged = slim.withColumn("range", range_of("place")).withColumn("guest", F.lit(0))
    # The first document of each range, one row per range.
    heads = ranged.groupBy("range").agg(F.min("place").alias("place"))
    firsts = ranged.join(F.broadcast(heads), ["range", "place"]).groupBy("range").agg(F.min(F.struct("doc_id", "text")).alias("first"))
    before = F.lag("range").over(Window.orderBy("range"))
    last = F.max("range").over(Window.partitionBy())
    guests = firsts.withColumn("to", F.coalesce(before, last)).select("first.doc_id", "first.text", F.col("to").alias("range"), F.lit(1).alias("guest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, str]] = []
        at = None
        for piece in byte_steps(batches):
            rows = list(zip(piece.column("range").to_pylist(), piece.column("doc_id").to_pylist(), piece.column("text").to_pylist(), strict=True))
            now, following, out = [], [], []
            for range_, doc_id, text in rows:
                if held and at == range_:
                    now.append(held.pop())
                    following.append((doc_id, text))
                    if len(now) > 1 and following[-2] != now[-1]:  # a new range begins in this piece
                        out += compared(now[:-1], following[:-1])
                        now, following = now[-1:], following[-1:]
                held, at = [(doc_id, text)], range_  # a range's guest comes last, so what is held across ranges is done with
            if now:
                out += compared(now, following)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=SCHEMA)

    dealt = ranged.drop("place").unionByName(guests).repartition("range").sortWithinPartitions("range", "guest", F.col("doc_id").asc_nulls_first(), "text")
    return dealt.mapInArrow(run, RESULT)


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def near_duplicates(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """doc_id, class_id and n_links of every document whose shingle set is at least ``similarity`` like another's.

    Equal shingle sets are one node.  Every two nodes that share a band are compared, in the first band that
    they share, by the exact Jaccard similarity of their shingle sets.  A band's nodes are
    dealt to tasks that each compare two blocks of them; a task gives out a spanning forest
    and counts of links, no pairs.  Classes are the components of the verified links,
    and ``n_links`` counts these.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in byte_steps(batches):
            raw, bounds = text_bytes(piece.column("text"))
            words, _, ends = hashing.word_hashes(raw, bounds)
            found, runs = hashing.shingles(words, ends, WORDS)
            least = least_values(found, runs)
            sets = [np.unique(found[s:e]).view(np.int64) for s, e in zip(runs[:-1], runs[1:], strict=True)]
            yield pa.RecordBatch.from_pydict({
                "doc_id": piece.column("doc_id"), "bands": [[hash_of(r[k : k + BAND_ROWS]) for k in range(0, PERMUTATIONS, BAND_ROWS)] for r in least],
                "shingles": pa.array([s.tolist() for s in sets], pa.list_(pa.int64()))})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, bands array<long>, shingles array<long>")
    rows = checkpointed(rows.filter(F.size("shingles") > 0).withColumn("node", F.xxhash64("shingles")))
    nodes = rows.groupBy("node").agg(F.first("bands").alias("bands"), F.first("shingles").alias("shingles"), F.min("doc_id").alias("least"))
    nodes = checkpointed(nodes)
    banded = nodes.select("node", F.size("shingles").alias("n"), F.posexplode("bands").alias("band", "key"))
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    crowded = banded.groupBy("band", "key").agg(F.count("*").alias("several"), blocks.alias("blocks")).filter("several > 1").drop("several")
    own = banded.drop("n").join(crowded, ["band", "key"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, F.col("block")).alias("i"), F.greatest(x, F.col("block")).alias("j")))
    dealt = own.withColumn("pair", F.explode(others)).select("band", "key", "pair.i", "pair.j", "block", "node")
    groups_of = ["band", "key", "i", "j"]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, group in grouped(batches, groups_of, 1):
            node, known, label = rows.column("node").to_numpy(), Sets(rows.column("shingles")), np.arange(rows.num_rows)
            count = np.zeros(rows.num_rows, np.int64)
            a, b = [], []
            for p, q in band_pairs(rows, group):
                some = known.possible(p, q, similarity)
                for x, y in zip(p[some].tolist(), q[some].tolist(), strict=True):
                    if known.alike(x, y, similarity):
                        count[x] += 1
                        count[y] += 1
                        if united(label, x, y):
                            a.append(x)
                            b.append(y)
            some = np.flatnonzero(count)
            a, b = (node[np.concatenate([np.array(x, np.int64), some])] for x in (a, b))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.concatenate([np.zeros(len(a) - len(some), np.int64), count[some]]))], ["a", "b", "n"])

    placed = dealt.join(nodes.select("node", "bands", "shingles"), "node").select(*dealt.columns, "bands", "shingles").repartition(*groups_of).sortWithinPartitions(*groups_of)
    # Links of a forest (n = 0), and of every node with itself the number of its links.
    verified = checkpointed(placed.mapInArrow(check, "a long, b long, n long"))
    links = verified.filter("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n_links"))
    named = connected_components(verified)
    joined = nodes.select("node", "least").join(named, "node", "left").join(links, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = joined.groupBy("component").agg(F.min("least").alias("class_id"))
    return rows.select("doc_id", "node").join(joined.join(ids, "component").select("node", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links")), "node").select("doc_id", "class_id", "n_links")


def band_pairs(rows: pa.Table, group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs within groups, each in the first band it shares and one task only, in steps of at most a pair a row."""
    lists = pa.concat_arrays(rows.column("bands").chunks)
    bands = lists.flatten().to_numpy().reshape(len(lists), -1)
    band, block = rows.column("band").to_numpy(), rows.column("block").to_numpy()
    single = rows.column("i").to_numpy() == rows.column("j").to_numpy()
    for by in range(1, int(np.bincount(group).max())):
        p = np.flatnonzero(group[:-by] == group[by:])
        p = p[single[p] | (block[p] != block[p + by])]
        for at in range(0, len(p), STEP):
            x = p[at : at + STEP]
            own = x[np.argmax(bands[x] == bands[x + by], axis=1) == band[x]]
            if len(own):
                yield own, own + by


def hash_of(band: np.ndarray) -> int:
    """A band's components as one signed long."""
    return int.from_bytes(hashlib.blake2b(band.astype("<u4").tobytes(), digest_size=8).digest(), "little", signed=True)
