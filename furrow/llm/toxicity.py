"""Toxicity by a classifier chain.

The categories stand in a fixed order.  Each has a logistic model over the hashed
different words of a text and the probabilities of all earlier categories.  What a
later model is trained on are out-of-fold probabilities: each training row's
earlier probabilities come from models fitted without its fold, so the chain
learns how far to trust them.  The models are fitted in numpy, on a bounded sample of
``TRAIN_DOCS`` labelled documents taken by a hash, equal texts once; whole texts are scored.

``labels.toxic`` marks the last category.  The two before it are the two kinds of toxic documents that
the training rows themselves show: the words that tell toxic from other documents are
found, and the toxic documents parted in two by which of these words they hold together
(Lloyd's rounds on unit vectors, started from the two most unlike documents).  No word is given.

Defined cases: a null text counts as empty; a category without positive (or without
negative) training rows has the mean label as its constant probability (0 without any rows); rows
without id or label are never learned from; repeated labels of equal texts count once; repeated documents
give one result row each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm import hashing
from furrow.llm.common import byte_steps, text_bytes, with_columns

#: Labelled documents that the chain is fitted on.
TRAIN_DOCS = 10000
BUCKET_BITS = 18
FOLDS = 3
#: Words of a model: how many at most, in how many documents at least, and how many standard errors apart between the classes.
MOST_WORDS, LEAST_DOCS, APART = 300, 3, 5.0
#: L2 penalty and most Newton steps of a model.
L2, STEPS = 0.1, 40
#: Probability from which a category counts as present.
PRESENT = 0.5

#: The kinds that the training rows show, the larger one first, and the labelled category.
CATEGORIES = ("kind_1", "kind_2", "toxic")
#: Rounds that part the toxic documents.
KIND_ROUNDS = 20


def word_buckets(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different word buckets of every text, ascending, and their n + 1 bounds.

    Everything that is no ASCII letter or digit, and not part of a longer character, parts words.
    """
    words, _, ends = hashing.word_hashes(PLAIN[raw], bounds)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(ends))
    pairs = np.unique(text << BUCKET_BITS | hashing.buckets(words, BUCKET_BITS))
    return pairs & ((1 << BUCKET_BITS) - 1), np.searchsorted(pairs >> BUCKET_BITS, np.arange(len(bounds)))


PLAIN = np.arange(256, dtype=np.uint8)
PLAIN[[i for i in range(128) if not chr(i).isalnum()]] = 32


@dataclass
class Logistic:
    """Weights of the word buckets, of the earlier probabilities, and the bias."""

    words: np.ndarray
    earlier: np.ndarray
    bias: float

    def chance(self, found: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(hashing.sum_by_text(self.words[found], ends) + before @ self.earlier + self.bias, -30, 30)))


def telling_words(rows: list[np.ndarray], label: np.ndarray) -> np.ndarray:
    """Buckets whose share of documents differs clearly between the classes, at most ``MOST_WORDS``, ascending."""
    flat, own = np.concatenate(rows), np.repeat(label, [len(r) for r in rows])
    size = 1 << BUCKET_BITS
    with_one, every = np.bincount(flat, own, size), np.bincount(flat, minlength=size)
    ones, zeros = label.sum(), len(label) - label.sum()
    share = np.clip(every / len(label), 1e-9, 1 - 1e-9)
    spread = np.sqrt(share * (1 - share) * (1 / ones + 1 / zeros))
    apart = np.abs(with_one / ones - (every - with_one) / zeros) / spread
    apart[every < LEAST_DOCS] = 0
    best = np.argsort(-apart, kind="stable")[:MOST_WORDS]
    return np.sort(best[apart[best] >= APART])


def fit_logistic(rows: list[np.ndarray], before: np.ndarray, label: np.ndarray) -> Logistic:
    """Logistic regression on the telling words and the earlier probabilities, by Newton steps with an L2 penalty."""
    size, extra = 1 << BUCKET_BITS, before.shape[1]
    if len(label) == 0 or label.min() == label.max():
        mean = float(np.clip(label.mean() if len(label) else 0.0, 1e-4, 1 - 1e-4))
        return Logistic(np.zeros(size), np.zeros(extra), float(np.log(mean / (1 - mean))))
    picked = telling_words(rows, label)
    x = np.zeros((len(rows), len(picked) + extra + 1))
    for i, r in enumerate(rows):
        x[i, np.searchsorted(picked, np.intersect1d(r, picked, assume_unique=True))] = 1.0
    x[:, len(picked) : -1] = before
    x[:, -1] = 1.0
    penalty = np.append(np.full(x.shape[1] - 1, L2), 1e-6)
    w = np.zeros(x.shape[1])
    for _ in range(STEPS):
        chance = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        move = np.linalg.solve(x.T @ (x * np.maximum(chance * (1 - chance), 1e-6)[:, None]) + np.diag(penalty), x.T @ (label - chance) - penalty * w)
        w += move * min(1.0, 4.0 / max(np.abs(move).max(), 1e-12))
        if np.abs(move).max() < 1e-6:
            break
    words = np.zeros(size)
    words[picked] = w[: len(picked)]
    return Logistic(words, w[len(picked) : -1], float(w[-1]))


def buckets_of(texts: list[bytes]) -> list[np.ndarray]:
    """The different word buckets of each text."""
    return [word_buckets(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0].astype(np.int32) for t in texts]


def fit_chain(rows: list[np.ndarray], labels: np.ndarray) -> list[Logistic]:
    """One model for each column of ``labels`` in order; the earlier probabilities it learns from are out-of-fold."""
    fold = np.random.default_rng(5).permutation(len(rows)) % FOLDS
    before, models = np.zeros((len(rows), 0)), []
    for k in range(labels.shape[1]):
        models.append(fit_logistic(rows, before, labels[:, k]))
        if k + 1 < labels.shape[1]:
            outside = np.zeros(len(rows))
            for f in range(FOLDS):
                inside, left = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
                part = fit_logistic([rows[i] for i in inside], before[inside], labels[inside, k])
                outside[left] = [part.chance(rows[i], np.array([0, len(rows[i])]), before[i : i + 1])[0] for i in left]
            before = np.column_stack([before, outside])
    return models


def chain_scores(models: list[Logistic], raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Probability of every category (columns, in order) of every text."""
    found, ends = word_buckets(raw, bounds)
    before = np.zeros((len(bounds) - 1, 0))
    for model in models:
        before = np.column_stack([before, model.chance(found, ends, before)])
    return before


def category_labels(rows: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """0 or 1 of the two kinds and of toxic; a toxic row without a telling word is of neither kind.

    ``rows`` are the word buckets of the texts.  With fewer than two different sets of telling words there is one kind.
    """
    labels = np.column_stack([np.zeros((len(rows), 2)), toxic])
    if len(rows) == 0 or toxic.min() == toxic.max():
        return labels
    picked = telling_words(rows, toxic)
    held = np.zeros((len(rows), len(picked)))
    for i, r in enumerate(rows):
        held[i, np.searchsorted(picked, np.intersect1d(r, picked, assume_unique=True))] = 1.0
    mine = toxic > 0
    held = held[:, held[mine].mean(axis=0) > held[~mine].mean(axis=0)]
    some = np.flatnonzero(mine & held.any(axis=1))
    unit = held[some] / np.sqrt(held[some].sum(axis=1, keepdims=True)) if len(some) else held[some]
    kind = np.zeros(len(some), np.int64)
    if len(some):
        first = int((unit @ unit.sum(axis=0)).argmin())
        centres = unit[[first, int((unit @ unit[first]).argmin())]]
        for _ in range(KIND_ROUNDS):
            kind = (unit @ centres.T).argmax(axis=1)
            sums = np.array([unit[kind == k].sum(axis=0) for k in (0, 1)])
            centres = np.where((kind[:, None] == [0, 1]).any(axis=0)[:, None], sums / np.maximum(np.sqrt((sums**2).sum(axis=1, keepdims=True)), 1e-12), centres)
    if (kind == 1).sum() > (kind == 0).sum():
        kind = 1 - kind
    labels[some, kind] = 1.0
    return labels


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> list[Logistic]:
    """The chain, fitted in one task on at most ``train_docs`` rows of ``labels`` (doc_id, toxic) joined with their texts."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("label")).filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
    order = F.xxhash64("doc_id", F.lit(3))
    picked = known.orderBy(order, "doc_id", "label").limit(train_docs)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id").orderBy(order, "doc_id", "label", "text").limit(train_docs)

    def run(_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "label", "text"])
        pdf = pdf.drop_duplicates("text")
        found = buckets_of([t.encode() for t in pdf["text"]])
        models = fit_chain(found, category_labels(found, pdf["label"].to_numpy(float)))
        return pd.DataFrame({"category": range(len(models)), "words": [m.words.astype("<f4").tobytes() for m in models],
                             "earlier": [m.earlier.tolist() for m in models], "bias": [m.bias for m in models]})

    found = rows.groupBy(F.lit(0).alias("all")).applyInPandas(run, "category int, words binary, earlier array<double>, bias double").collect()
    if not found:
        return fit_chain([], np.zeros((0, len(CATEGORIES))))
    return [Logistic(np.frombuffer(bytes(r["words"]), "<f4"), np.array(r["earlier"], float), r["bias"]) for r in sorted(found, key=lambda r: r["category"])]


def score(docs: DataFrame, models: list[Logistic], present: float = PRESENT) -> DataFrame:
    """``docs`` with p_kind_1, p_kind_2, p_toxic and the flag toxic."""
    new = [f"p_{c}" for c in CATEGORIES]
    names = [c for c in docs.columns if c not in (*new, "toxic")]
    slim = docs.select(*names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in byte_steps(batches):
            found = chain_scores(models, *text_bytes(piece.column("text")))
            columns = {n: pa.array(found[:, k]) for k, n in enumerate(new)}
            yield with_columns(piece, names, **columns, toxic=pa.array(found[:, -1] >= present))

    return slim.mapInArrow(run, f"{schema}, {', '.join(f'{n} double' for n in new)}, toxic boolean")


def toxicity_scores(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, p_kind_1, p_kind_2, p_toxic, toxic of every document."""
    return score(docs.select("doc_id", "text"), fit(docs, labels, train_docs)).drop("text")
