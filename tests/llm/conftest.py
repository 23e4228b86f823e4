import pytest
from pyspark.sql import types as T

LONG = " ".join(f"word{i % 977} tail{i % 31}," for i in range(40_000))
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()), *[T.StructField(n, T.StringType()) for n in (
        "size", "key", "name", "taken", "row", "words", "score", "lang_pred", "fp", "component", "base", "spans", "range", "guest", "label", "place", "cuts", "leak_id", "text_hash", "held_out", "_place", "_text", "_only", "_lang_pred", "lang_score", "doc")]])


def table(spark, rows):
    """Documents (doc_id, text, lang, source) with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), *(f"x{k}" for k in range(26))) for i, t, lang, s in rows], SCHEMA)


AWKWARD = [
    (1, "the quick brown fox jumps over the lazy dog and runs away from it", "en", "b"),
    (2, None, "en", "b"), (3, "", None, None), (4, " \t\n ", "en", "a"), (5, "!!! 123 ...", "en", "a"),
    (6, "the quick brown fox jumps over the lazy dog and runs away from it", "en", "a"),
    (7, LONG, "en", "c"), (7, LONG, "en", "c"), (8, "tie", "de", "c"), (8, "tie", "de", "c"), (8, "other text under the same id", None, "c"),
    (None, "no id here but some words to read in this one", "en", None), (None, None, None, None), (9, "naïve café über straße \U0001f600 mail me", "fr", "a"),
]


@pytest.fixture(scope="session")
def awkward(spark):
    return table(spark, AWKWARD)


@pytest.fixture(scope="session")
def nothing(spark):
    return table(spark, [])


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
