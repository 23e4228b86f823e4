import importlib
import sys

import corpus_pipeline
from furrow.llm import mixing
from tests.llm.conftest import table


def test_stages_follow_each_other(spark, sf, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "source_mix", "token_output"]
    now = docs
    sizes = []
    for _, stage in corpus_pipeline.STAGES[:3]:
        now = stage(spark, now, sf).cache()
        assert now.columns == docs.columns
        sizes.append(now.count())
    assert sizes[0] <= docs.count() and sizes[1] < sizes[0] and sizes[2] < sizes[1]
    mixed = corpus_pipeline.source_mix(spark, now, sf)
    assert mixed.schema == docs.schema
    words = now.select(mixing.word_count(now["text"]).alias("n")).groupBy().sum("n").first()[0]
    got = mixed.select(mixing.word_count(mixed["text"]).alias("n")).groupBy().sum("n").first()[0]
    assert abs(got - words) <= 20  # one word a source by rounding


def test_whole_run(spark, sf):
    out = corpus_pipeline.run(spark, sf).collect()
    assert out and all(r["n_tokens"] >= 1 for r in out)
    ordered = sorted(out, key=lambda r: r["start"])
    assert [r["start"] for r in ordered] == [sum(x["n_tokens"] for x in ordered[:k]) for k in range(len(ordered))]


def test_planted_rows(spark, sf):
    bench = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("text").collect()]
    import random

    rng = random.Random(2)

    def prose(n=150):
        return " ".join(rng.choice(["the", "and", "of", "this", "that", "in"]) + rng.choice(["", "er", "on", "ing", "tion"]) + str(rng.randrange(99)) for _ in range(n))

    clean = [prose() for _ in range(12)]
    rows = [(k, t, "en", "s") for k, t in enumerate(clean)] + [(50, clean[0], "en", "s"), (51, clean[1] + " end", "en", "s"), (52, prose(40) + " " + bench[0] + " " + prose(40), "en", "s"), (53, None, "en", "s"), (54, "12 34 !!", "en", "s")]
    now = table(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES[:3]:
        now = stage(spark, now, sf)
    assert sorted(r["doc_id"] for r in now.collect()) == list(range(12))


def test_stages_keep_every_column_and_take_an_empty_table(spark, sf, nothing, awkward):
    """Columns that are called as inner ones come back with their values; an empty table goes through all stages."""
    now = awkward
    for _, stage in corpus_pipeline.STAGES[:4]:
        now = stage(spark, now, sf)
        assert now.columns == awkward.columns
        now = spark.createDataFrame(now.collect(), awkward.schema)
        assert now.count() and now.filter("_place <> 'x20' OR _lang_pred <> 'x23' OR row <> 'x4' OR doc <> 'x25'").count() == 0
    empty = nothing
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf)
        assert empty.count() == 0
        assert name == "token_output" or empty.columns == nothing.columns
        empty = empty if name == "token_output" else spark.createDataFrame([], nothing.schema)


def test_entry_works_without_the_subpackage(monkeypatch):
    class Missing:
        def find_spec(self, name, path=None, target=None):
            if name.startswith(("furrow.llm", "corpus_pipeline")):
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    held = {n: m for n, m in sys.modules.items() if n.startswith(("furrow.llm", "corpus_pipeline", "__spark_entry__"))}
    for n in held:
        monkeypatch.delitem(sys.modules, n)
    monkeypatch.delattr(sys.modules["furrow"], "llm", raising=False)
    monkeypatch.setattr(sys, "meta_path", [Missing(), *sys.meta_path])
    entry = importlib.import_module("__spark_entry__")
    assert entry.queries() and not any(q.startswith("op") or q == "pipeline" for q in entry.queries())
    monkeypatch.undo()
    sys.modules.update(held)
    sys.modules["furrow"].llm = held["furrow.llm"]
