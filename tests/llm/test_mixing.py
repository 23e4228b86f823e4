import re
from collections import Counter

import duckdb
import pytest

from furrow.llm import mixing
from furrow.llm import queries as Q
from tests.llm.conftest import AWKWARD, table


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_agrees_with_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    df = Q.op1_mixing(spark, sf)
    cur = con.execute(mixing.MIX_SQL)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.select(*names)) == sorted(cur.fetchall(), key=str)


def test_many_ranges_agree_with_one(spark, docs, monkeypatch):
    whole = rows_of(mixing.mix_plan(docs))
    monkeypatch.setattr(mixing, "RANGE_ROWS", 8)
    assert rows_of(mixing.mix_plan(docs)) == whole


def test_targets_are_reshared(spark):
    sizes = spark.createDataFrame([("a", "=a", 10), ("b", "=b", 1000), ("c", "=c", 5), (None, "", 0)], "source string, name string, source_size long")
    got = {r["name"]: r["target"] for r in mixing.targets(sizes).collect()}
    # c would get more than three times its size, then a would, and b takes what is left.
    assert got == {"=a": 30.0, "=b": pytest.approx(970.0), "=c": 15.0, "": 0.0}


def test_awkward_rows(awkward):
    got = mixing.mix_plan(awkward).collect()
    assert len(got) == len(AWKWARD)
    assert Counter(r["size"] for r in got) == Counter(words(t) for _, t, *_ in AWKWARD)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    assert sum(r["taken"] for r in got) == pytest.approx(sum(r["size"] for r in got), abs=len(AWKWARD))


def test_alike_rows_share_the_cut(spark):
    df = table(spark, [(1, "a b c d e f", "en", "s")] * 4 + [(2, "x " * 100, "en", "t")])
    taken = {r["taken"] for r in mixing.mix_plan(df).filter("doc_id = 1").collect()}
    assert len(taken) == 1


def test_mixed_documents_have_the_planned_words(docs, awkward):
    for df in (docs, awkward):
        planned = {}
        for r in mixing.mix_plan(df).collect():
            planned[r["doc_id"]] = planned.get(r["doc_id"], 0) + r["taken"]
        mixed = mixing.mixed_documents(df)
        assert mixed.columns == df.columns
        got = {}
        for r in mixed.collect():
            got[r["doc_id"]] = got.get(r["doc_id"], 0) + words(r["text"])
        assert got == {k: v for k, v in planned.items() if v}


def test_empty(nothing):
    assert mixing.mix_plan(nothing).count() == 0
    assert mixing.mixed_documents(nothing).count() == 0
