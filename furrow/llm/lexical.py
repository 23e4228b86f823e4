"""Ranked lexical search, term at a time with a limited set of accumulators.

Documents become rows of (document, length, its query terms with their counts), written
once.  Spark adds up the collection's figures from them.  Then each task inverts the
rows of a shard and works through every item's terms, rarest first: a document gets an
accumulator with its first term, until the upper bounds of the terms left no longer
reach the k-th best partial score; from then on only documents that have an accumulator
are updated, exactly.  A task's k best of an item carry over to its next shard, as a
bound from the start.  The k best of all tasks are ranked by a window.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type, to_arrow_type

from furrow.llm.common import STEP_BYTES
from furrow.session import cut_lineage

#: Terms are runs of ASCII letters, digits and all characters beyond ASCII; A-Z count as a-z.  All else is a blank here.
FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))
#: Different terms that one pass over the documents looks for; a pass ends with the item that reaches it.
PASS_TERMS = 200_000
#: Term counts that a shard holds, about.
SHARD_POSTINGS = 1 << 20
SHARD_SCHEMA = "doc_id long, n long, terms array<int>, counts array<long>"


class Item(NamedTuple):
    """An item and its terms (number, repeats)."""

    item_id: object
    terms: list[tuple[int, int]]


def term_counts(text: str | None) -> Counter[bytes]:
    """How often each term occurs in a text; a long text is parted in steps."""
    raw = (text or "").encode("utf-8", "replace").translate(FOLD)
    out: Counter[bytes] = Counter()
    start = 0
    while start < len(raw):
        stop = raw.find(b" ", start + STEP_BYTES)
        stop = len(raw) if stop < 0 else stop
        out.update(raw[start:stop].split())
        start = stop
    return out


def passes(items: DataFrame, key: str, column: str, most: int) -> Iterator[tuple[list[Item], dict[bytes, int]]]:
    """Items in groups whose different terms number ``most`` or little more, with the numbers of these terms."""
    group: list[Item] = []
    numbers: dict[bytes, int] = {}
    rows = items.groupBy(F.col(key).alias("item_id")).agg(F.min(column).alias("text")).orderBy("item_id")
    for row in rows.toLocalIterator():
        group.append(Item(row["item_id"], [(numbers.setdefault(t, len(numbers)), c) for t, c in term_counts(row["text"]).items()]))
        if len(numbers) >= most:
            yield group, numbers
            group, numbers = [], {}
    if numbers:
        yield group, numbers


def forward(docs: DataFrame, numbers: dict[bytes, int], key: str, column: str) -> DataFrame:
    """Of every document with a term: doc_id, its length ``n`` in terms, the looked-for terms and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n, terms, counts = [], [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                found = term_counts(text.as_py())
                if found:
                    own = found.keys() & numbers.keys()
                    ids.append(doc_id)
                    n.append(found.total())
                    terms.append([numbers[t] for t in own])
                    counts.append([found[t] for t in own])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "counts"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(column).alias("text")).mapInArrow(run, SHARD_SCHEMA)


class Shard:
    """Inverted rows of some documents: postings by term, each with the score that it adds, and each term's bound."""

    def __init__(self, batches: list[pa.RecordBatch], weights: np.ndarray, documents: int, length: int) -> None:
        table = pa.Table.from_batches(batches)
        lists = pa.concat_arrays(table.column("terms").chunks)
        self.ids, self.null = table.column("doc_id").fill_null(0).to_numpy(), table.column("doc_id").is_null().to_numpy()
        n = table.column("n").to_numpy()
        lengths, which = np.unique(n, return_inverse=True)
        m = np.array([25 + 75 * x * documents // length for x in lengths.tolist()], dtype=np.int64)[which]
        doc = np.repeat(np.arange(len(n)), lists.value_lengths().to_numpy())
        term, tf = lists.flatten().to_numpy(), pa.concat_arrays(table.column("counts").chunks).flatten().to_numpy()
        order = np.argsort(term, kind="stable")
        self.doc, term, tf = doc[order], term[order], tf[order]
        self.adds = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[self.doc]))
        self.ends = np.concatenate(([0], np.cumsum(np.bincount(term, minlength=len(weights)))))
        self.bound = np.zeros(len(weights), np.int64)
        there = np.flatnonzero(np.diff(self.ends))
        if len(there):
            self.bound[there] = np.maximum.reduceat(self.adds, self.ends[there])

    def best(self, plan: list[tuple[int, int]], k: int, bar: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores that hold the ``k`` best of the shard if these reach ``bar``.

        ``plan`` has an item's terms (number, repeats), rarest first.
        """
        steps = [(t, q) for t, q in plan if self.bound[t]]
        left = sum(q * int(self.bound[t]) for t, q in steps)
        score = np.zeros(len(self.ids), np.int64)
        creating, made = True, False
        for t, q in steps:
            if creating:
                kth = int(np.partition(score, -k)[-k]) if made and len(score) >= k else 0
                creating = left >= max(bar, kth)
                if not creating and not made:
                    break
            at = slice(self.ends[t], self.ends[t + 1])
            docs, adds = self.doc[at], q * self.adds[at]
            if not creating:
                old = score[docs] > 0
                docs, adds = docs[old], adds[old]
            score[docs] += adds
            made = True
            left -= q * int(self.bound[t])
        least = max(1, bar, int(np.partition(score, -k)[-k]) if len(score) >= k else 0)
        docs = np.flatnonzero(score >= least)
        order = np.lexsort((self.ids[docs], self.null[docs], -score[docs]))[:k]
        return docs[order], score[docs][order]


def ranked_pass(docs: DataFrame, items: list[Item], numbers: dict[bytes, int], k: int, key: str, column: str, kind: pa.DataType, shard_postings: int) -> DataFrame:
    """The ``k`` best documents of every task for the items of one pass: item_id, doc_id, score."""
    rows = cut_lineage(forward(docs, numbers, key, column), "postings")
    size = rows.agg(F.count("*").alias("n"), F.sum("n").alias("l")).first()
    documents, length = size["n"], size["l"]
    holding = np.zeros(len(numbers), np.int64)
    for r in rows.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        holding[r["term"]] = r["count"]
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for df in holding.tolist()], dtype=np.int64)
    plans = [sorted(item.terms, key=lambda t: (holding[t[0]], t[0])) for item in items]
    ids = [item.item_id for item in items]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, bool, int]]] = [[] for _ in ids]  # (-score, id is null, id), ascending

        def take(held: list[pa.RecordBatch]) -> None:
            shard = Shard(held, weights, documents, length)
            for own, plan in zip(best, plans, strict=True):
                found, score = shard.best(plan, k, -own[-1][0] if len(own) == k else 0)
                if len(found):
                    own += zip((-score).tolist(), shard.null[found].tolist(), shard.ids[found].tolist(), strict=True)
                    own.sort()
                    del own[k:]

        held, count = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                count += len(batch.column("terms").flatten()) + batch.num_rows
            if count >= shard_postings:
                take(held)
                held, count = [], 0
        if held:
            take(held)
        flat = [(n, *row) for n, own in enumerate(best) for row in own]
        yield pa.RecordBatch.from_arrays([pa.array([ids[n] for n, *_ in flat], kind), pa.array([None if null else d for *_, null, d in flat], pa.int64()), pa.array([-s for _, s, *_ in flat], pa.int64())], ["item_id", "doc_id", "score"])

    return rows.mapInArrow(run, f"item_id {items_type(kind)}, doc_id long, score long")


def items_type(kind: pa.DataType) -> str:
    """Spark's name of an Arrow type."""
    return from_arrow_type(kind).simpleString()


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, doc_key: str = "doc_id", doc_text: str = "text", item_key: str = "item_id", item_text: str = "text", pass_terms: int = PASS_TERMS, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """item_id, rank, doc_id, score of the ``k`` documents that score highest for each item.

    The score of a document sums, over the item's terms with repeats, w * ((10^9 tf) div (1000 tf + 8 m)),
    where w is floor(1000 ln((2 N + 2) / (2 df + 1))) and m is 25 + (75 n N) div L (N documents with a term,
    L terms in all, n terms in the document).  Only scores above 0 count; equal scores rank by ascending
    doc_id, null last.  Null and termless texts count nowhere.  Every row of documents is a document, also
    if its id is repeated or null; items that share an id are one item with the least of the texts, and one
    without terms has no rows.  Empty tables give no rows.  Other columns are not read.
    """
    kind = to_arrow_type(items.schema[item_key].dataType)
    found = [ranked_pass(docs, group, numbers, k, doc_key, doc_text, kind, shard_postings) for group, numbers in passes(items, item_key, item_text, pass_terms)]
    if not found:
        return docs.sparkSession.createDataFrame([], f"item_id {items_type(kind)}, rank int, doc_id long, score long")
    whole = found[0]
    for more in found[1:]:
        whole = whole.union(more)
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return whole.withColumn("rank", place).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
RANKED_SQL = f"""
WITH parted AS MATERIALIZED (SELECT row_number() OVER () AS place, doc_id, {_TERMS} AS terms FROM documents),
lengths AS (SELECT place, doc_id, len(terms) AS n FROM parted WHERE len(terms) > 0),
size AS (SELECT count(*) AS docs, sum(n) AS length FROM lengths),
wanted AS (SELECT item_id, term, count(*) AS repeats FROM (SELECT item_id, unnest({_TERMS}) AS term FROM (SELECT item_id, min(text) AS text FROM benchmark GROUP BY item_id)) GROUP BY item_id, term),
postings AS MATERIALIZED (SELECT place, term, count(*) AS tf FROM (SELECT place, unnest(terms) AS term FROM parted) WHERE term IN (SELECT term FROM wanted) GROUP BY place, term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * max(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM postings, size GROUP BY term),
scored AS (SELECT item_id, place, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // length)))) AS score
    FROM wanted JOIN weights USING (term) JOIN postings USING (term) JOIN lengths USING (place), size GROUP BY item_id, place)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM (
    SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored JOIN lengths USING (place) WHERE score > 0)
WHERE rank <= 10"""
