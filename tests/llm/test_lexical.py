import math
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from furrow.llm import lexical
from furrow.llm import queries as Q
from tests.llm.conftest import AWKWARD, LONG, table

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parted(text):
    return TERM.findall((text or "").translate(LOWER))


def plain_ranking(docs, items, k=10):
    """Scores of every document for every item, as (item_id, rank, doc_id, score)."""
    counted = [(d, Counter(parted(t))) for d, t in docs]
    counted = [(d, c, c.total()) for d, c in counted if c]
    size, length = len(counted), sum(n for *_, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    texts = defaultdict(list)
    for i, t in items:
        texts[i].append(t)
    out = []
    for i, of in texts.items():
        wanted = parted(min((t for t in of if t is not None), default=None))
        scored = []
        for d, c, n in counted:
            m = 100 - 75 + 75 * n * size // length
            s = sum(math.floor(1000 * math.log((2 * size + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in wanted if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(i, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def items_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", "x", 0) for i, t in rows], "item_id long, text string, doc_id string, terms string, rank int")


def test_agrees_with_sql(spark, sf):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    df = Q.op12_lexical(spark, sf)
    cur = con.execute(lexical.RANKED_SQL)
    assert df.columns == [d[0] for d in cur.description]
    assert rows_of(df) == sorted(cur.fetchall(), key=str)


@pytest.fixture(scope="module")
def given(spark, sf):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    return items, [(r["item_id"], r["text"]) for r in items.collect()]


def test_small_shards_and_passes_change_nothing(docs, texts, given):
    items, plain = given
    want = plain_ranking(texts, plain)
    assert rows_of(lexical.ranked(docs.repartition(2), items, shard_postings=300)) == want
    assert rows_of(lexical.ranked(docs, items, pass_terms=400)) == want


def test_accumulators_are_limited(monkeypatch, docs, given):
    """The bounds end the making of accumulators: fewer than all postings are added."""
    from furrow.llm.common import bounded_batches

    bounded_batches(docs.sparkSession)
    groups = list(lexical.passes(given[0], "item_id", "text", lexical.PASS_TERMS))
    items, numbers = groups[0]
    rows = lexical.forward(docs, numbers, "doc_id", "text").toArrow().combine_chunks().to_batches()
    n = sum(b.num_rows for b in rows)
    length = sum(sum(b.column("n").to_pylist()) for b in rows)
    holding = Counter(t for b in rows for ts in b.column("terms").to_pylist() for t in ts)
    import numpy as np

    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * holding[t] + 1))) for t in range(len(numbers))])
    shard = lexical.Shard(rows, weights, n, length)
    held = [np.unique(np.concatenate([shard.doc[shard.ends[t] : shard.ends[t + 1]] for t, _ in i.terms])).size for i in items]
    made = []
    zeros = np.zeros

    def watched(*a, **kw):
        made.append(zeros(*a, **kw))
        return made[-1]

    monkeypatch.setattr(lexical.np, "zeros", watched)
    for item in items:
        shard.best(sorted(item.terms, key=lambda t: (holding[t[0]], t[0])), 10, 0)
    monkeypatch.undo()
    assert sum((m > 0).sum() for m in made) < sum(held)


def test_awkward_rows(spark, awkward):
    items = [(1, "The QUICK brown fox fox"), (2, None), (3, ""), (3, "tie"), (3, "other"), (None, "no id naïve café"), (5, "naïve-straße 😀 word7 tail3"), (6, "unheard-of"), (1, "the quick brown fox"), (7, LONG)]
    assert rows_of(lexical.ranked(awkward, items_of(spark, items))) == plain_ranking([(i, t) for i, t, *_ in AWKWARD], items)


def test_ties_go_to_smaller_ids(spark):
    rows = [(i, "same words here", "en", "s") for i in range(40, 0, -1)] + [(99, "other text", "en", "s")]
    got = rows_of(lexical.ranked(table(spark, rows).repartition(3), items_of(spark, [(1, "same words")]), shard_postings=8))
    assert sorted((r, d) for _, r, d, _ in got) == [(i, i) for i in range(1, 11)]


def test_long_texts_are_parted_at_blanks(monkeypatch):
    monkeypatch.setattr(lexical, "STEP_BYTES", 5)
    text = "one TWO three, four-four ünf five"
    assert lexical.term_counts(text) == Counter(t.encode() for t in parted(text))


def test_empty(spark, nothing):
    some = items_of(spark, [(1, "a b")])
    assert lexical.ranked(nothing, some).collect() == []
    assert lexical.ranked(table(spark, [(1, "a b", "en", "s")]), items_of(spark, [])).collect() == []
    assert lexical.ranked(table(spark, [(1, None, "en", "s")]), some).collect() == []
