"""Approximate nearest neighbours by an inverted multi-index.

Unit vectors are cut in two halves, each quantised with its own codebook; a pair of
codewords is a cell, and every vector lies in one cell.  A query visits cells in the
order of the summed distances of its halves to the two codewords, taken from a heap,
until the cells hold as many entries as the budget says, and the entries of these cells
are ranked by their exact cosine.

The codebooks come from a bounded sample, the budget from a bounded number of queries
whose true neighbours are found by a pass over all rows: it is the number of entries
within which the wished share of the true neighbours is met.  Everything else reads all
rows.  Entries and queries are joined by the first codeword, both sides dealt to blocks
of bounded size, so no task takes a whole codeword however full it is.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.llm.vectors import finite, large_pieces, matrix
from furrow.session import cut_lineage

#: Rows that the codebooks are fitted on, and queries that the budget is measured on.
SAMPLE_ROWS, SAMPLE_QUERIES = 16_384, 256
#: Codewords of a half grow with the root of the number of entries up to this.
MAX_CODEWORDS = 1024
ENTRIES_A_CELL = 16
#: Share of the sampled queries' true neighbours that the budget must reach.
RECALL = 0.96
#: Most rows of a side that one task compares.
BLOCK_ROWS = 4096
ROUNDING = 1e-9


class Book(NamedTuple):
    """Two codebooks over the two halves of vectors with ``dim`` components."""

    dim: int
    halves: tuple[np.ndarray, np.ndarray]

    def distances(self, unit: np.ndarray) -> list[np.ndarray]:
        """Squared distance of each vector's halves to the codewords."""
        cut = self.halves[0].shape[1]
        return [squared(part, words) for part, words in zip((unit[:, :cut], unit[:, cut:]), self.halves, strict=True)]


def squared(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (points**2).sum(axis=1)[:, None] - 2 * points @ centres.T + (centres**2).sum(axis=1)


def balanced(vectors: np.ndarray) -> np.ndarray:
    """Vectors times a power of two each, so that no square overflows; directions stay exactly."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, initial=0.0))[1][:, None])


def units(vectors: np.ndarray) -> np.ndarray:
    even = balanced(vectors)
    return even / np.sqrt((even**2).sum(axis=1))[:, None]


def cosines(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Row by row, the same for equal vectors wherever they stand."""
    a, b = balanced(left), balanced(right)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def usable(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """``id`` and ``vector`` of the rows that take part, one row an id (of several the least vector)."""
    plain = vectors.select(F.col(key).alias("id"), F.col(column).alias("vector"))
    return plain.filter(F.col("id").isNotNull() & finite(F.col("vector")) & F.exists("vector", lambda x: x != 0)).groupBy("id").agg(F.min("vector").alias("vector"))


def entries_of(rows: DataFrame, k: int) -> DataFrame:
    """Rows that can be among the nearest: of equal vectors the k + 1 smallest ids, one of which may be the query."""
    place = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    return rows.withColumn("place", place).filter(F.col("place") <= k + 1).drop("place")


def fit(rows: DataFrame, dim: int, codewords: int, sample: int = SAMPLE_ROWS, rounds: int = 10) -> Book:
    """Codebooks by Lloyd's rounds over the ``sample`` rows of the smallest hash of the id, in one task."""
    picked = rows.select(F.xxhash64("id").alias("order"), "id", "vector").orderBy("order", "id").limit(sample)
    cut = max(dim // 2, 1)

    def train(table: pa.Table) -> pa.Table:
        table = table.sort_by([("order", "ascending"), ("id", "ascending")])
        unit = units(matrix(table.column("vector"), dim, np.float64))
        found = []
        for points in (unit[:, :cut], unit[:, cut:]):
            centres = points[:codewords].copy()
            for _ in range(rounds):
                near = squared(points, centres).argmin(axis=1)
                order = np.argsort(near, kind="stable")
                own, first = np.unique(near[order], return_index=True)
                centres[own] = np.add.reduceat(points[order], first) / np.bincount(near)[own, None]
            found.append(centres)
        return pa.table({"half": pa.array(np.repeat([0, 1], [len(c) for c in found]), pa.int32()), "word": [r.tolist() for c in found for r in c]},
                        schema=pa.schema([("half", pa.int32()), ("word", pa.list_(pa.float64()))]))

    words = picked.groupBy(F.lit(0).alias("all")).applyInArrow(train, "half int, word array<double>").collect()
    return Book(dim, tuple(np.array([r["word"] for r in words if r["half"] == h], dtype=np.float64) for h in (0, 1)))


def coded(entries: DataFrame, book: Book) -> DataFrame:
    """Entries with the numbers ``i`` and ``j`` of the nearest codewords."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in large_pieces(batches, BLOCK_ROWS):
            i, j = (d.argmin(axis=1) for d in book.distances(units(matrix(piece.column("vector"), book.dim, np.float64))))
            yield from piece.append_column("i", pa.array(i, pa.int32())).append_column("j", pa.array(j, pa.int32())).to_batches()

    return entries.mapInArrow(run, f"{columns(entries)}, i int, j int")


def columns(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)


def budget_of(entries: DataFrame, queries: DataFrame, book: Book, cells: np.ndarray, k: int, recall: float, sample: int = SAMPLE_QUERIES) -> int:
    """Entries to visit: the ``recall`` quantile of where the true neighbours of sampled queries are met."""
    asked = queries.orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    unit = units(matrix(pa.array([r["vector"] for r in asked], pa.list_(pa.float64())), book.dim, np.float64))
    own = np.array([r["id"] for r in asked])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros(0, [("q", np.int32), ("score", np.float64), ("i", np.int32), ("j", np.int32)])
        for piece in large_pieces(batches, BLOCK_ROWS):
            score = units(matrix(piece.column("vector"), book.dim, np.float64)) @ unit.T
            score[piece.column("id").to_numpy()[:, None] == own] = -np.inf
            top = np.argpartition(-score, min(k, len(score)) - 1, axis=0)[:k]
            new = np.zeros(top.size, best.dtype)
            new["q"], new["score"] = np.tile(np.arange(len(own)), len(top)), np.take_along_axis(score, top, 0).ravel()
            new["i"], new["j"] = (piece.column(c).to_numpy()[top].ravel() for c in "ij")
            both = np.concatenate([best, new[new["score"] > -2]])
            both = both[np.lexsort((-both["score"], both["q"]))]
            best = both[np.arange(len(both)) - np.searchsorted(both["q"], both["q"]) < k]
        yield pa.RecordBatch.from_arrays([pa.array(best[c]) for c in best.dtype.names], list(best.dtype.names))

    order = Window.partitionBy("q").orderBy(F.desc("score"), "i", "j")
    true = entries.mapInArrow(run, "q int, score double, i int, j int").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).collect()
    if not true:
        return k + 1
    first, second = book.distances(unit)
    met = []
    for r in true:
        total = first[r["q"]][:, None] + second[r["q"]]
        met.append(int(cells[total <= total[r["i"], r["j"]]].sum()))
    return max(k + 1, sorted(met)[math.ceil(recall * len(met)) - 1])


def traverse(first: np.ndarray, second: np.ndarray, cells: np.ndarray, budget: int) -> tuple[list[int], list[int]]:
    """Non-empty cells by summed distance until they hold ``budget`` entries."""
    rows, cols = np.argsort(first, kind="stable").tolist(), np.argsort(second, kind="stable").tolist()
    one, two = first[rows].tolist(), second[cols].tolist()
    heap = [(one[0] + two[0], 0, 0)]
    seen_i, seen_j, held = [], [], 0
    while heap and held < budget:
        _, a, b = heapq.heappop(heap)
        # Only the next codeword of either half can follow; a row of pairs begins when the row before it has.
        if b + 1 < len(two):
            heapq.heappush(heap, (one[a] + two[b + 1], a, b + 1))
        if b == 0 and a + 1 < len(one):
            heapq.heappush(heap, (one[a + 1] + two[0], a + 1, 0))
        count = int(cells[rows[a], cols[b]])
        if count:
            held += count
            seen_i.append(rows[a])
            seen_j.append(cols[b])
    return seen_i, seen_j


def visits(queries: DataFrame, book: Book, cells: np.ndarray, budget: int) -> DataFrame:
    """A row for each query and first codeword that it visits, with the second codewords to look at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            first, second = book.distances(units(matrix(batch.column("vector"), book.dim, np.float64)))
            row, i, js = [], [], []
            for q in range(batch.num_rows):
                a, b = map(np.array, traverse(first[q], second[q], cells, budget))
                order = np.lexsort((b, a))
                one, start = np.unique(a[order], return_index=True)
                row += [q] * len(one)
                i += one.tolist()
                js += np.split(b[order], start[1:])
            ends = np.concatenate(([0], np.cumsum([len(x) for x in js])))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(js), pa.int32()))
            for s in range(0, len(row), 500):
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(row[s : s + 500])) for c in ("id", "vector")), pa.array(i[s : s + 500], pa.int32()), lists[s : s + 500]], ["id", "vector", "i", "js"])

    return queries.select("id", "vector").mapInArrow(run, f"{columns(queries.select('id', 'vector'))}, i int, js array<int>")


def blocks(df: DataFrame, words: int, rows: int) -> list[int]:
    """For every first codeword, in how many blocks of about ``rows`` rows its rows are dealt."""
    out = [1] * words
    for r in df.groupBy("i").count().collect():
        out[r["i"]] = max(1, math.ceil(r["count"] / rows))
    return out


def rank(queries: pa.Table, entries: pa.Table, dim: int, k: int) -> pa.Table:
    """The k nearest entries of one block for each query of one block, among the cells that it visits."""
    entries = entries.sort_by([("j", "ascending"), ("id", "ascending")])
    left, right = (matrix(t.column("vector"), dim, np.float64) for t in (queries, entries))
    left_unit, right_unit, j = units(left), units(right), entries.column("j").to_numpy()
    js = pa.concat_arrays(queries.column("js").chunks)
    wish, asker = js.flatten().to_numpy(), np.repeat(np.arange(len(left)), js.value_lengths().to_numpy())
    order = np.argsort(wish, kind="stable")
    wish, asker = wish[order], asker[order]
    floor = np.full(len(left), -np.inf)
    pairs = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    cell, start = np.unique(j, return_index=True)
    for word, s, e in zip(cell.tolist(), start.tolist(), [*start[1:].tolist(), len(j)], strict=True):
        rows = asker[np.searchsorted(wish, word) : np.searchsorted(wish, word, side="right")]
        for at in range(0, len(rows), 512):
            some = rows[at : at + 512]
            score = left_unit[some] @ right_unit[s:e].T
            if e - s > k:  # k + 1, for one of them may be the query's own row
                floor[some] = np.maximum(floor[some], np.partition(score, e - s - k - 1, axis=1)[:, e - s - k - 1])
            r, c = np.nonzero(score >= floor[some][:, None] - ROUNDING)
            pairs.append((some[r], c + s, score[r, c]))
    q, x, rough = (np.concatenate(p) for p in zip(*pairs, strict=True))
    keep = rough >= floor[q] - ROUNDING
    q, x = q[keep], x[keep]
    ids, own = entries.column("id").to_numpy()[x], queries.column("id").to_numpy()[q]
    other = ids != own
    q, x, ids, own = q[other], x[other], ids[other], own[other]
    score = np.concatenate([cosines(left[q[s : s + BLOCK_ROWS]], right[x[s : s + BLOCK_ROWS]]) for s in range(0, len(q), BLOCK_ROWS)] or [np.zeros(0)])
    order = np.lexsort((ids, -score, q))
    order = order[np.arange(len(q)) - np.searchsorted(q[order], q[order]) < k]
    return pa.table({"query_id": own[order], "vec_id": ids[order], "score": score[order]})


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, recall: float = RECALL, key: str = "vec_id", column: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows of largest cosine found for each query, ties to smaller ids.

    ``is_query`` is a condition on ``id``.  Rows with a null id, or whose vector is null, empty, zero or
    holds null or non-finite components, take no part; rows that repeat an id are one row (that of the
    least vector); missing components of shorter vectors count as zero.  A query has fewer than ``k``
    rows only if there are fewer other rows.  Of equal vectors only the k + 1 smallest ids enter the
    index, since a later one cannot be among the k nearest.  No usable rows or no queries: no rows.
    Other columns are not read.
    """
    rows = cut_lineage(usable(vectors, key, column), "vectors")
    entries = entries_of(rows, k)
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dim")).first()
    queries = rows.filter(is_query)
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"query_id {kind}, vec_id {kind}, score double"
    if not size["n"]:
        return vectors.sparkSession.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    words = min(MAX_CODEWORDS, max(1, math.ceil(math.sqrt(size["n"] / ENTRIES_A_CELL))))
    book = fit(rows, size["dim"], words)
    placed = cut_lineage(coded(entries, book), "cells")
    cells = np.zeros((len(book.halves[0]), len(book.halves[1])), np.int64)
    for r in placed.groupBy("i", "j").count().collect():
        cells[r["i"], r["j"]] = r["count"]
    budget = budget_of(placed, queries, book, cells, k, recall)
    seen = cut_lineage(visits(queries, book, cells, budget), "visits")
    deal_e, deal_q = (blocks(df, len(cells), block_rows) for df in (placed, seen))
    number = lambda counts: F.element_at(F.array(*[F.lit(c) for c in counts]), F.col("i") + 1)
    own = lambda counts: F.pmod(F.xxhash64("id"), number(counts)).cast("int")
    every = lambda counts: F.explode(F.sequence(F.lit(0), number(counts) - 1))
    left = seen.withColumn("e", every(deal_e)).withColumn("q", own(deal_q))
    right = placed.withColumn("q", every(deal_q)).withColumn("e", own(deal_e))
    dim = book.dim

    def compare(asked: pa.Table, there: pa.Table) -> pa.Table:
        if not asked.num_rows or not there.num_rows:
            return pa.table({"query_id": asked.column("id").slice(0, 0), "vec_id": there.column("id").slice(0, 0), "score": pa.array([], pa.float64())})
        return rank(asked, there, dim, k)

    found = left.groupBy("i", "e", "q").cogroup(right.groupBy("i", "e", "q")).applyInArrow(compare, schema)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
