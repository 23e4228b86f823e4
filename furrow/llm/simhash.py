"""SimHash fingerprints and their links within a Hamming radius, compared by bit planes.

A fingerprint takes one bit from each of the 64 bit positions: set if more than
half of the document's shingle hashes have it set.  Documents are linked if their
fingerprints differ in at most ``radius`` bits.

Two fingerprints within the radius agree on at least two of ``radius + 2`` bit
blocks, so candidates are sought among fingerprints that share two whole blocks.
Within such a bucket fingerprints are compared bit-sliced: one plane per bit
position, holding that bit of many fingerprints, and the distances of a whole
block counted at once by carry-save bitwise adders.

Defined cases: a null or blank text has fingerprint zero and is linked like any
other; a text shorter than a shingle is one shingle of all its words; equal
fingerprints are one class; repeated rows and repeated ids give one result row
each; an empty table gives an empty result; other columns of the input are ignored.
A null id takes part but is never the name of a component, unless no member has an id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm import hashing
from furrow.llm.common import byte_steps, checkpointed, connected_components, text_bytes, with_columns

BITS = 64
#: Rows of a bucket that one task compares with as many others.
BLOCK_ROWS = 2048
#: Shingles that the rows of such a block have together.
BLOCK_SHINGLES = 1 << 19
#: Bits of the bitmap that a shingle set is first compared by.
PARITY_BITS = 4096
#: Rows up to which the documents to verify are broadcast; beyond it the join is left to Spark.
BROADCAST_ROWS = 1_000_000
#: Place of a null id.
LOWEST = -(1 << 63)


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """SimHash of one text as an unsigned integer."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    flat = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    span = min(words, len(tokens))
    count = len(tokens) - span + 1
    hashes = np.fromiter(
        (xxhash.xxh64_intdigest(flat[s:e], seed) for s, e in zip(starts[:count].tolist(), ends[span - 1 :].tolist(), strict=True)),
        dtype="<u8", count=count)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, count, 1 << 16):  # whole texts, in bounded pieces
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp) of every row; ``fp`` holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in byte_steps(batches):
            found = np.array([fingerprint(t, words, seed) for t in piece.column("text").to_pylist()], dtype=np.uint64)
            yield with_columns(piece, ["doc_id"], fp=pa.array(found.view(np.int64)))

    slim = docs.select("doc_id", "text")
    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, fp long")


def planes(values: np.ndarray) -> np.ndarray:
    """64 x ceil(n / 64) words: bit i of plane b is bit b of value i; padding is zero."""
    padded = np.zeros(-(-len(values) // 64) * 64, dtype="<u8")
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def shifted(stack: np.ndarray, by: int, words: int) -> np.ndarray:
    """The first ``words`` words of planes moved so that bit i is bit i + ``by``; the planes must reach that far."""
    whole, part = divmod(by, 64)
    low = stack[..., whole : whole + words]
    if not part:
        return low
    return low >> np.uint64(part) | stack[..., whole + 1 : whole + 1 + words] << np.uint64(64 - part)


def within(left: np.ndarray, right: np.ndarray, radius: int) -> np.ndarray:
    """Words of bits that are 1 where two stacks of planes differ in at most ``radius`` bits.

    Carry-save counters: word k of ``count`` holds bit k of many distances; a distance that
    passes the counters' range stays marked in ``over``.  A block of 64 distances is
    abandoned once all of them are past the radius, the whole once all blocks are.
    """
    width = max(1, int(radius).bit_length())
    alive = np.arange(left.shape[1])
    count = [np.zeros(len(alive), np.uint64) for _ in range(width)]
    over = np.zeros(len(alive), np.uint64)
    out = np.zeros(left.shape[1], np.uint64)
    for b in range(BITS):
        carry = left[b] ^ right[b]
        for k in range(width):
            here = count[k]
            count[k] = here ^ carry
            carry &= here
        over |= carry
        if b % 8 == 7 and 24 <= b < BITS - 1:
            near = ~(over | above(count, radius)) != 0
            if not near.any():
                return out
            if 2 * np.count_nonzero(near) < len(alive):
                alive, over, left, right = alive[near], over[near], left[:, near], right[:, near]
                count = [c[near] for c in count]
    out[alive] = ~(over | above(count, radius))
    return out


def above(count: list[np.ndarray], radius: int) -> np.ndarray:
    """Bits that are 1 where the counter is greater than ``radius``."""
    more = np.zeros_like(count[0])
    same = ~more
    for k in reversed(range(len(count))):
        if radius >> k & 1:
            same &= count[k]
        else:
            more |= same & count[k]
            same &= ~count[k]
    return more


def forest(values: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (a, b) of links within groups that connect all that the radius connects, none between what is connected already.

    ``group`` numbers the rows' groups; a group's rows stand together.
    """
    label = np.arange(len(values))
    a, b = [], []
    for left, right in near_pairs(values, group, radius):
        differ = label[left] != label[right]
        for i, j in zip(left[differ].tolist(), right[differ].tolist(), strict=True):
            if united(label, i, j):
                a.append(i)
                b.append(j)
        flatten(label)
    return np.array(a, np.int64), np.array(b, np.int64)


def near_pairs(values: np.ndarray, group: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs within groups that differ in at most ``radius`` bits, in steps of at most a pair a row.

    A group's rows stand together.  Rows are put in the order of falling group size and compared with
    the row 1, 2, 3, ... places on, all at once, as long as a group is that long.
    """
    size = np.bincount(group)[group]
    order = np.lexsort((group, -size))
    values, group, size = values[order], group[order], size[order]
    stack = planes(np.concatenate([values, np.zeros(128 + int(size[0]), np.uint64)]))
    for by in range(1, int(size[0])):
        rows = int(np.searchsorted(-size, -by, side="left"))  # rows of groups of more than ``by``
        words = -(-rows // 64)
        near = np.flatnonzero(np.unpackbits(within(stack[:, :words], shifted(stack, by, words), radius).view(np.uint8), bitorder="little")[:rows])
        near = near[near + by < len(values)]
        near = near[group[near] == group[near + by]]
        if len(near):
            yield order[near], order[near + by]


def united(label: np.ndarray, i: int, j: int) -> bool:
    """Connect rows i and j; whether they were apart."""
    x, y = root(label, i), root(label, j)
    label[max(x, y)] = min(x, y)
    return x != y


def flatten(label: np.ndarray) -> None:
    """Give every row the least row connected with it so far."""
    while not np.array_equal(flat := label[label], label):
        label[:] = flat


def root(label: np.ndarray, i: int) -> int:
    """Least row connected with row i so far."""
    while label[i] != i:
        i = int(label[i])
    return i


def bit_blocks(radius: int) -> list[int]:
    """Masks of ``radius + 2`` bit blocks."""
    edges = np.linspace(0, BITS, radius + 3).round().astype(int)
    return [((1 << int(hi)) - 1) ^ ((1 << int(lo)) - 1) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]


def block_pairs(radius: int) -> list[int]:
    """Masks of every two of ``radius + 2`` bit blocks."""
    return [x | y for x, y in combinations(bit_blocks(radius), 2)]


def signed(value: int) -> int:
    """An unsigned 64-bit number as Spark's long."""
    return value - (1 << 64) if value >> 63 else value


def links(distinct: DataFrame, radius: int = 4, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Links (a, b) between different fingerprints that connect all that the radius connects.

    ``distinct`` has one column ``fp`` without repeats.  A bucket of more than
    ``block_rows`` rows is dealt to tasks that each compare two of its blocks, so no
    task takes a whole large bucket and no candidate is left out.
    """
    masks = block_pairs(radius)
    keyed = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m))) for m in masks])).alias("way", "key"))
    large = keyed.groupBy("way", "key").count().filter(F.col("count") > 1).withColumn("blocks", F.ceil(F.col("count") / block_rows).cast("int"))
    own = keyed.join(large.drop("count"), ["way", "key"]).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, F.col("block")).alias("i"), F.greatest(x, F.col("block")).alias("j")))
    dealt = own.withColumn("pair", F.explode(others)).select("way", "key", "pair.i", "pair.j", "fp")

    groups_of = ["way", "key", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, group in grouped(batches, groups_of):
            fp = rows.column("fp").to_numpy().view(np.uint64)
            a, b = forest(fp, group, radius)
            yield pa.RecordBatch.from_arrays([pa.array(fp[x].view(np.int64)) for x in (a, b)], ["a", "b"])

    placed = dealt.repartition(*groups_of).sortWithinPartitions(*groups_of)
    return placed.mapInArrow(run, "a long, b long").distinct()


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 1 << 18) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows in pieces of whole groups, of about ``rows`` rows, and their group numbers."""
    held: list[pa.RecordBatch] = []
    count = 0

    def cut(last: bool) -> Iterator[tuple[pa.Table, np.ndarray]]:
        nonlocal held, count
        table = pa.Table.from_batches(held)
        columns = [table.column(k).to_numpy() for k in keys]
        new = np.concatenate(([False], np.logical_or.reduce([c[1:] != c[:-1] for c in columns])))
        stop = table.num_rows if last else int(np.flatnonzero(new)[-1]) if new.any() else 0
        if stop:
            yield table.slice(0, stop), np.cumsum(new[:stop])
        held = table.slice(stop).to_batches()
        count = table.num_rows - stop

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            count += batch.num_rows
        if count >= rows:
            yield from cut(False)
    if count:
        yield from cut(True)


def near_classes(prints: DataFrame, radius: int = 4, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, fp, component_id) from (doc_id, fp): the least id reachable over links.

    Equal fingerprints are pre-aggregated, so copies cost one candidate; the graph is
    that of different fingerprints only.
    """
    prints = checkpointed(prints)
    classes = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = connected_components(links(classes.select("fp"), radius, block_rows))
    rooted = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    roots = rooted.groupBy("component").agg(F.min("least").alias("component_id"))
    names = rooted.join(roots, "component").select("fp", "component_id")
    return prints.join(names, "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp) -> F.Column:
    """16 lowercase hex digits of a long."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def simhash_components(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint, component_id of every document."""
    return near_classes(fingerprints(docs, words), radius).select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def text_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, ascending."""
    raw, bounds = text_bytes(texts)
    tokens, _, ends = hashing.word_hashes(raw, bounds)
    found, runs = hashing.shingles(tokens, ends, words)
    return [np.unique(found[s:e]) for s, e in zip(runs[:-1], runs[1:], strict=True)]


def nodes_of(docs: DataFrame, words: int) -> DataFrame:
    """_place, _text, fp, node and n of every row: a hash of fingerprint and shingle set together, and the set's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in byte_steps(batches):
            prints = np.array([fingerprint(t, words) for t in piece.column("text").to_pylist()], dtype=np.uint64)
            sets = text_sets(piece.column("text"), words)
            node = np.array([xxhash.xxh3_64_intdigest(x.tobytes(), int(p)) for p, x in zip(prints, sets, strict=True)], dtype=np.uint64)
            yield with_columns(piece, ["_place", "_text"], fp=pa.array(prints.view(np.int64)), node=pa.array(node.view(np.int64)), n=pa.array([len(x) for x in sets], pa.int64()))

    return docs.select("_place", "_text", "text").mapInArrow(run, "_place long, _text long, fp long, node long, n long")


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """``node`` and the distinct shingle hashes of ``text``, ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in byte_steps(batches):
            sets = text_sets(piece.column("text"), words)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for x in sets]))), pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
            yield pa.RecordBatch.from_arrays([piece.column("node"), lists], ["node", "shingles"])

    return docs.select("node", "text").mapInArrow(run, "node long, shingles array<long>")


class Sets:
    """Shingle sets of a piece's rows, with a bitmap each that tells most unlike pairs apart without a loss.

    Bit b of a bitmap is the parity of the shingles whose low bits are b, so two bitmaps differ in
    no more bits than the sets in shingles: the intersection they allow is never too small.
    """

    def __init__(self, lists: pa.ChunkedArray) -> None:
        lists = pa.concat_arrays(lists.chunks)
        self.flat = lists.flatten().to_numpy()
        self.bounds = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
        self.size = np.diff(self.bounds)
        self.parity = np.zeros((len(lists), PARITY_BITS // 64), np.uint64)
        for at in range(0, len(lists), 256):
            stop = min(at + 256, len(lists))
            row = np.repeat(np.arange(stop - at), self.size[at:stop])
            bit = self.flat[self.bounds[at] : self.bounds[stop]] & (PARITY_BITS - 1)
            odd = np.bincount(row * PARITY_BITS + bit, minlength=(stop - at) * PARITY_BITS) & 1
            self.parity[at:stop] = np.packbits(odd.astype(np.uint8).reshape(-1, PARITY_BITS), axis=1, bitorder="little").view(np.uint64)

    def possible(self, p: np.ndarray, q: np.ndarray, similarity: float) -> np.ndarray:
        """Which pairs the sizes and bitmaps allow to be ``similarity`` alike."""
        total = self.size[p] + self.size[q]
        least = np.abs(self.size[p] - self.size[q])
        for at in range(0, len(p), 1024):
            step = slice(at, at + 1024)
            least[step] = np.maximum(least[step], np.bitwise_count(self.parity[p[step]] ^ self.parity[q[step]]).sum(axis=1, dtype=np.int64))
        both = (total - least) / 2
        return both >= similarity * (total - both)

    def alike(self, p: int, q: int, similarity: float) -> bool:
        """Whether the Jaccard similarity of two rows is at least ``similarity``."""
        x, y = (self.flat[self.bounds[k] : self.bounds[k + 1]] for k in (p, q))
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both >= similarity * (len(x) + len(y) - both)


def open_pairs(rows: pa.Table, group: np.ndarray, radius: int, label: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the near pairs whose labels differ when they are given out, each pair in one bucket and one task only.

    A pair belongs to the bucket of its first two equal bit blocks, and to the task of its two blocks of rows.
    """
    fp, way, block = rows.column("fp").to_numpy().view(np.uint64), rows.column("way").to_numpy(), rows.column("block").to_numpy()
    single = rows.column("i").to_numpy() == rows.column("j").to_numpy()
    blocks = np.array(bit_blocks(radius), np.uint64)
    first, second = (np.array(x) for x in zip(*combinations(range(len(blocks)), 2), strict=True))
    for p, q in near_pairs(fp, group, radius):
        some = (label[p] != label[q]) & (single[p] | (block[p] != block[q]))
        p, q = p[some], q[some]
        for k, mask in enumerate(blocks):
            some = (fp[p] ^ fp[q]) & mask != 0
            some |= (k >= second[way[p]]) | (k == first[way[p]])
            p, q = p[some], q[some]
        if len(p):
            yield p, q


def further_links(nodes: DataFrame, sets: DataFrame, radius: int, similarity: float, block_rows: int = BLOCK_ROWS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Verified links (a, b) that connect all nodes that near and alike nodes of other components connect.

    ``nodes`` has fp, node, n and the component known so far.  Every near pair of different
    components is looked at in one task.  A first pass finds the nodes that have such a
    pair; only their shingle sets go to the tasks that compare them, which unite two
    nodes if their sets are alike.  Buckets are dealt as in ``links``, also by the size of their sets.
    """
    masks = block_pairs(radius)
    keyed = nodes.select("fp", "node", "n", "component", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m))) for m in masks])).alias("way", "key"))
    blocks = F.greatest(F.ceil(F.count("*") / block_rows), F.ceil(F.sum("n") / block_shingles)).cast("int")
    mixed = keyed.groupBy("way", "key").agg(F.min("component").alias("low"), F.max("component").alias("high"), blocks.alias("blocks")).filter("low <> high").drop("low", "high")
    own = keyed.drop("n").join(mixed, ["way", "key"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, F.col("block")).alias("i"), F.greatest(x, F.col("block")).alias("j")))
    groups_of = ["way", "key", "i", "j"]
    dealt = own.withColumn("pair", F.explode(others)).select("way", "key", "pair.i", "pair.j", "block", "fp", "node", "component")

    def labels(rows: pa.Table) -> np.ndarray:
        """The first row of each row's component."""
        _, first, back = np.unique(rows.column("component").to_numpy(), return_index=True, return_inverse=True)
        return first[back]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, group in grouped(batches, groups_of):
            seen = np.zeros(rows.num_rows, bool)
            for p, q in open_pairs(rows, group, radius, labels(rows)):
                seen[p] = seen[q] = True
            yield from rows.filter(pa.array(seen)).to_batches()

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, group in grouped(batches, groups_of, 1):
            node, label, known = rows.column("node").to_numpy(), labels(rows), Sets(rows.column("shingles"))
            a, b = [], []
            for p, q in open_pairs(rows, group, radius, label):
                some = known.possible(p, q, similarity)
                for x, y in zip(p[some].tolist(), q[some].tolist(), strict=True):
                    if root(label, x) != root(label, y) and known.alike(x, y, similarity):
                        united(label, x, y)
                        a.append(x)
                        b.append(y)
                flatten(label)
            yield pa.RecordBatch.from_arrays([pa.array(node[np.array(x, np.int64)]) for x in (a, b)], ["a", "b"])
            del rows, group, node, label, known
            pa.default_memory_pool().release_unused()

    marked = checkpointed(dealt.repartition(*groups_of).sortWithinPartitions(*groups_of).mapInArrow(mark, dealt.schema))
    placed = marked.join(sets, "node").select(*dealt.columns, "shingles").repartition(*groups_of).sortWithinPartitions(*groups_of)
    return placed.mapInArrow(check, "a long, b long")


def near_unique(docs: DataFrame, words: int = 5, radius: int = 10, similarity: float = 0.8) -> DataFrame:
    """One document of each group of near duplicates: the one of the least id.  Columns as in ``docs``.

    Two documents are linked if their SimHash differs in at most ``radius`` bits and the Jaccard similarity of
    their shingle sets is at least ``similarity``, equal fingerprints included; a group is what links connect.
    A spanning forest of the radius is verified first, which connects most; then all near pairs
    that are not connected by that.  Of rows alike in id and text one stays.
    """
    # The document's row is one struct, so that no name of its columns can clash.
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    keyed = packed.select("row", F.coalesce(F.col("row")["doc_id"].cast("long"), F.lit(LOWEST)).alias("_place"), F.coalesce(F.xxhash64(F.col("row")["text"]), F.lit(0)).alias("_text"), F.col("row")["text"].alias("text"))
    prints = checkpointed(nodes_of(keyed, words))
    nodes = checkpointed(prints.groupBy("fp", "node", "n").agg(F.min("_place").alias("_place")))
    classes = checkpointed(nodes.groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("several")))
    found = checkpointed(links(classes.select("fp"), radius))
    linked = found.select(F.explode(F.array("a", "b")).alias("fp")).distinct().withColumn("linked", F.lit(True))
    open_nodes = checkpointed(nodes.join(classes, "fp").join(linked, "fp", "left").filter("linked OR several > 1").select("fp", "node", "n", "_place", "first"))
    # The texts to verify with: of every such node one row of its least id.
    shown = checkpointed(open_nodes.select("node", "_place").join(prints, ["node", "_place"]).groupBy("node", "_place").agg(F.min("_text").alias("_text")))
    few = F.broadcast(shown) if shown.count() <= BROADCAST_ROWS else shown
    sets = checkpointed(shingle_sets(keyed.select("_place", "_text", "text").join(few, ["_place", "_text"]).select("node", "text").dropDuplicates(["node"]), words))
    first = classes.select("fp", "first")
    between = found.join(first.toDF("a", "x"), "a").join(first.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    pairs = between.union(open_nodes.filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")))
    both = F.size(F.array_intersect("x", "y"))
    alike = (pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
             .filter(both >= similarity * (F.size("x") + F.size("y") - both)).select("a", "b"))
    known = checkpointed(connected_components(alike))
    further = further_links(open_nodes.join(known, "node", "left").select("fp", "node", "n", F.coalesce("component", "node").alias("component")), sets, radius, similarity)
    named = connected_components(known.select(F.col("node").alias("a"), F.col("component").alias("b")).union(further))
    rooted = prints.join(named, "node", "left").select("_place", "_text", F.coalesce("component", "node").alias("component"))
    least = rooted.groupBy("component").agg(F.min("_place").alias("_place"))
    stay = rooted.join(least, ["component", "_place"]).groupBy("component", "_place").agg(F.min("_text").alias("_text")).select("_place", "_text")
    # Rows alike in id and text: any one, picked on the map side already.
    one = keyed.join(stay, ["_place", "_text"]).groupBy("_place", "_text").agg(F.first("row").alias("row"))
    return one.select(*[F.col("row")[c].alias(c) for c in docs.columns])
