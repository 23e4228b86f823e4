import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.llm import hashing, langid, quality, toxicity
from furrow.llm import queries as Q
from tests.llm.conftest import AWKWARD, table


def held(doc_id, modulus, remainder):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % modulus == remainder


def test_profile_by_hand():
    grams, counts = langid.gram_counts("Ab a")
    assert sum(counts) == 3 + 5 + 4  # letters, pairs and triples of "_ab_a_"
    assert langid.top_grams("Ab a", 2).tolist() == [ord("a"), 1 | ord("a") << 21]


def test_distance_by_hand():
    profiles = langid.Profiles(["x", "y"], np.array([97, 98]), np.array([[0, 5], [1, 0]]), 5)
    top = langid.top_grams("aab", 5)
    assert profiles.closest("aab")[0] == "x"
    want = sum(abs({97: 0, 98: 1}.get(g, 5 + k) - k) for k, g in enumerate(top.tolist()))
    assert profiles.closest("aab")[1] == pytest.approx(1 - want / (5 * len(top)))


def test_language_of_held_out_documents(spark, sf, docs):
    got = {r["doc_id"]: r for r in Q.op2_langid(spark, sf).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert set(got) == set(truth) and all(got[i]["held_out"] == held(i, 4, 2) and 0 <= got[i]["score"] <= 1 for i in got)
    out = [i for i in got if got[i]["held_out"]]
    assert sum(got[i]["lang_pred"] == truth[i] for i in out) >= 0.98 * len(out)


def test_language_ignores_labels_of_held_out_rows(docs):
    wrong = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("none"))
    assert sorted(map(tuple, langid.identify(wrong).collect())) == sorted(map(tuple, langid.identify(docs).collect()))


def test_language_of_awkward_rows(awkward, nothing):
    got = langid.identify(awkward).collect()
    assert len(got) == len(AWKWARD)
    assert all((r["lang_pred"] == "und") == (r["score"] == 0) for r in got)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (2, 3, 4, 5)} == {"und"}
    kept = langid.with_language(awkward)
    assert kept.columns == awkward.columns and kept.filter("score <> 'x6' OR lang_pred <> 'x7'").count() == 0
    assert kept.count() == sum(any(c.isalpha() for c in t or "") for _, t, *_ in AWKWARD)
    assert langid.identify(nothing).count() == 0


def test_word_hashes_follow_plain_splitting():
    texts = ["A b  c", "", "c B\ta", " x", "é a", "abc"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    bounds = np.cumsum([0, *(len(t.encode()) for t in texts)])
    words, starts, ends = hashing.word_hashes(raw, bounds)
    named = {}
    for k, t in enumerate(texts):
        split = t.encode().lower().split()
        assert ends[k + 1] - ends[k] == len(split)
        for w, h in zip(split, words[ends[k] : ends[k + 1]].tolist(), strict=True):
            assert named.setdefault(w, h) == h
    assert len(set(named.values())) == len(named)
    runs, at = hashing.shingles(words, ends, 2)
    assert np.diff(at).tolist() == [2, 0, 2, 1, 1, 1]
    grams, at = hashing.byte_grams(raw, bounds, 3)
    assert np.diff(at).tolist() == [max(len(t.encode()) - 2, 0) for t in texts]


def test_quality_of_held_out_documents(spark, sf):
    sf = sf.replace("0.001", "0.01")  # enough labels to learn from
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = {r["doc_id"]: r for r in Q.op10_quality(spark, sf).collect()}
    assert all(r["held_out"] == held(i, 5, 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for i, r in got.items())
    out = [i for i in labels if got[i]["held_out"]]
    assert sum(got[i]["predicted"] == labels[i] for i in out) >= 0.9 * len(out)


def test_quality_learns_what_is_planted():
    good, bad = [f"plain words number {i} in a row".encode() for i in range(60)], [f"junk*** $$${i} %%% ***".encode() for i in range(60)]
    model = quality.train(good[:50] + bad[:50], np.array([1] * 50 + [0] * 50))
    rest = good[50:] + bad[50:]
    scores = model.scores(np.frombuffer(b"".join(rest), np.uint8), np.cumsum([0, *map(len, rest)]))
    assert (scores[:10] > 0.5).all() and (scores[10:] < 0.5).all()


def test_quality_of_awkward_rows(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 1), (7, 1, 0), (None, 1, 1), (8, None, None), (8, 1, 1), (8, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.quality_scores(awkward, labels).count() == len(AWKWARD)
    assert {r["score"] for r in quality.quality_scores(awkward, labels.limit(0)).collect()} == {0.5}
    assert quality.quality_scores(nothing, labels).count() == 0
    assert toxicity.toxicity_scores(awkward, labels).count() == len(AWKWARD)
    assert not any(r["toxic"] for r in toxicity.toxicity_scores(awkward, labels.limit(0)).collect())
    assert toxicity.toxicity_scores(nothing, labels).count() == 0


def test_toxic_documents_are_caught_held_out(spark, sf):
    """Two thirds of the labels teach; documents of the others, texts known from the first left out, are judged."""
    folder = sf.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    models = toxicity.fit(docs, labels.filter(~third))
    judged = docs.join(labels.filter(third).withColumnRenamed("toxic", "truth"), "doc_id").join(docs.join(labels.filter(~third), "doc_id").select("text").distinct(), "text", "left_anti")
    rows = toxicity.score(judged.select("doc_id", "text", "truth"), models).collect()
    toxic = [r for r in rows if r["truth"] == 1]
    caught, wrong = sum(r["toxic"] for r in toxic), sum(r["toxic"] for r in rows if r["truth"] == 0)
    assert len(toxic) > 10 and caught >= 0.88 * len(toxic) and wrong <= 0.005 * len(rows), (caught, len(toxic), wrong, len(rows))


def test_query_scores_equal_a_plain_chain(spark, sf, texts):
    """The query against the fitted chain walked word by word in plain Python."""
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    models = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r for r in Q.op3_toxicity(spark, sf).collect()}
    for i, text in texts[:60]:
        plain = "".join(c if ord(c) >= 128 or c.isalnum() else " " for c in text or "").split(" ")
        words = sorted({int(toxicity.hashing.buckets(toxicity.hashing.word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))[0], toxicity.BUCKET_BITS)[0]) for w in plain if w})
        before = []
        for model in models:
            margin = model.bias + sum(float(model.words[w]) for w in words) + sum(a * b for a, b in zip(model.earlier, before, strict=True))
            before.append(1 / (1 + np.exp(-np.clip(margin, -30, 30))))
        assert [got[i][f"p_{c}"] for c in toxicity.CATEGORIES] == pytest.approx(before, abs=1e-6) and got[i]["toxic"] == (before[-1] >= 0.5)


def test_kinds_come_from_the_words_alone():
    random = np.random.default_rng(6)
    words = lambda own: " ".join([*random.choice([f"w{i}" for i in range(40)], 12), *own]).encode()
    clean, one, two = [words([]) for _ in range(300)], [words(random.choice(["aa", "ab", "ac"], 2)) for _ in range(60)], [words(random.choice(["ba", "bb"], 2)) for _ in range(40)]
    rows, toxic = toxicity.buckets_of([*clean, *one, *two]), np.repeat([0.0, 1.0], [300, 100])
    labels = toxicity.category_labels(rows, toxic)
    assert labels[:300].sum() == 0 and (labels[:, 2] == toxic).all()
    assert labels[300:360, 0].mean() > 0.95 and labels[360:, 1].mean() > 0.95 and labels[300:360, 1].sum() + labels[360:, 0].sum() <= 3
    assert (toxicity.category_labels(rows[:5], np.zeros(5)) == 0).all() and toxicity.category_labels([], np.zeros(0)).shape == (0, 3)


def test_chain_feeds_out_of_fold_probabilities():
    random = np.random.default_rng(1)
    first = random.integers(0, 2, 400).astype(float)
    texts = [b"alpha beta" if f else b"gamma delta" for f in first]
    models = toxicity.fit_chain(toxicity.buckets_of(texts), np.column_stack([first, first, first]))
    assert [len(m.earlier) for m in models] == [0, 1, 2] and models[2].earlier.sum() > 0
    scores = toxicity.chain_scores(models, np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    assert ((scores > 0.5) == (first[:, None] > 0)).all()


def test_sample_is_bounded(spark):
    df = table(spark, [(i, f"some words {i}", "en", "s") for i in range(50)])
    assert langid.learn(df.filter("lang IS NOT NULL"), train_docs=3).languages == ["en"]


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 3)
    df = table(spark, [(i, f"words {i}", f"l{i % 4}", "s") for i in range(20)])
    assert langid.learn(df.filter("lang <> 'l3'")).languages == ["l0", "l1", "l2"]
    with pytest.raises(ValueError, match="languages"):
        langid.learn(df)


def test_unlearned_scripts_are_not_a_known_language(spark):
    df = table(spark, [(i, f"plain english words number {i}", "en", "s") for i in range(20)] + [(2000, "ქართული ტექსტი აქ არის", None, "s")])
    assert sorted(r["doc_id"] for r in langid.with_language(df).collect()) == list(range(20))
