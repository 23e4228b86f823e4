"""Document quality by supervised subword embeddings.

A text is the average of learned vectors: one for each hashed word and one for each hashed
character 3- and 4-gram, repeats included; a softmax layer on the average gives the class
probabilities.  Vectors and layer are fitted together by stochastic gradient
descent in numpy (AdaGrad steps), on a bounded sample of ``TRAIN_DOCS`` labelled
documents taken by a hash.  Since the average is linear, scoring needs one number
per hash bucket: the vector's share of the difference between the two classes.

Labels, language, source and id are never inputs of a score.

Defined cases: a null text counts as empty; an empty text scores what the layer's
bias says; without labelled rows of both classes every score is the mean label (0.5 if
there is none); rows without id or label are never learned from; repeated labels of
a document count each; repeated documents give one result row each; an empty table gives an empty result.
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
from furrow.llm.common import byte_steps, id_remainder, text_bytes, with_columns

#: Labelled documents that the model is fitted on.
TRAIN_DOCS = 4000
BUCKET_BITS = 17
WIDTH = 12
EPOCHS = 4
STEP = 0.05
GRAMS = (3, 4)
KEEP_FROM = 0.3


def features(raw: np.ndarray, bounds: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, bounds) of the words and of each kind of n-gram."""
    words, _, ends = hashing.word_hashes(raw, bounds)
    kinds = [(words, ends), *(hashing.byte_grams(raw, bounds, n) for n in GRAMS)]
    return [(hashing.buckets(h, BUCKET_BITS), e) for h, e in kinds]


@dataclass
class Model:
    """Share of every bucket in the log odds of label 1, and their bias."""

    shares: np.ndarray
    bias: float

    def scores(self, raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each text."""
        total, count = np.zeros(len(bounds) - 1), np.zeros(len(bounds) - 1)
        for found, ends in features(raw, bounds):
            total += hashing.sum_by_text(self.shares[found], ends)
            count += np.diff(ends)
        return 1.0 / (1.0 + np.exp(-(total / np.maximum(count, 1) + self.bias)))


def train(texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, step: float = STEP, seed: int = 7) -> Model:
    """Fit on whole texts; the order of the rows given does not depend on the cluster."""
    if len(labels) == 0 or labels.min() == labels.max():
        mean = float(np.clip(labels.mean() if len(labels) else 0.5, 0.001, 0.999))
        return Model(np.zeros(1 << BUCKET_BITS), float(np.log(mean / (1 - mean))))
    rows = []
    for text in texts:
        raw = np.frombuffer(text, np.uint8)
        ids, counts = np.unique(np.concatenate([b for b, _ in features(raw, np.array([0, len(raw)]))]), return_counts=True)
        rows.append((ids, (counts / max(counts.sum(), 1)).astype(np.float32)))
    random = np.random.default_rng(seed)
    vectors = random.normal(0, 1 / WIDTH, (1 << BUCKET_BITS, WIDTH)).astype(np.float32)
    layer, bias = random.normal(0, 0.1, (WIDTH, 2)).astype(np.float32), np.zeros(2, np.float32)
    square_v, square_l, square_b = np.full(vectors.shape, 1e-8, np.float32), np.full(layer.shape, 1e-8, np.float32), np.full(2, 1e-8, np.float32)
    for _ in range(epochs):
        for i in random.permutation(len(rows)):
            ids, share = rows[i]
            mean = share @ vectors[ids] if len(ids) else np.zeros(WIDTH, np.float32)
            logits = mean @ layer + bias
            chance = np.exp(logits - logits.max())
            wrong = (chance / chance.sum()).astype(np.float32)
            wrong[int(labels[i])] -= 1
            if len(ids):
                grad = share[:, None] * (layer @ wrong)[None, :]
                square_v[ids] += grad * grad
                vectors[ids] -= step * grad / np.sqrt(square_v[ids])
            grad = np.outer(mean, wrong)
            square_l += grad * grad
            layer -= step * grad / np.sqrt(square_l)
            square_b += wrong * wrong
            bias -= step * wrong / np.sqrt(square_b)
    return Model((vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", train_docs: int = TRAIN_DOCS) -> Model:
    """Fit on at most ``train_docs`` rows of ``labels`` (doc_id and 0 or 1) joined with their texts, in one task."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
    order = F.xxhash64("doc_id", F.lit(11))
    picked = known.orderBy(order, "doc_id", "label").limit(train_docs)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id").orderBy(order, "doc_id", "label", "text").limit(train_docs)

    def run(_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "label", "text"])
        model = train([t.encode() for t in pdf["text"]], pdf["label"].to_numpy())
        return pd.DataFrame({"shares": [model.shares.astype("<f4").tobytes()], "bias": [model.bias]})

    found = rows.groupBy(F.lit(0).alias("all")).applyInPandas(run, "shares binary, bias double").collect()
    if not found:
        return train([], np.zeros(0, np.int64))
    return Model(np.frombuffer(bytes(found[0]["shares"]), "<f4"), found[0]["bias"])


def score(docs: DataFrame, model: Model, keep_from: float = KEEP_FROM) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from ``keep_from`` on)."""
    names = [c for c in docs.columns if c not in ("score", "predicted")]
    slim = docs.select(*names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in byte_steps(batches):
            found = model.scores(*text_bytes(piece.column("text")))
            yield with_columns(piece, names, score=pa.array(found), predicted=pa.array((found >= keep_from).astype(np.int32)))

    return slim.mapInArrow(run, f"{schema}, score double, predicted int")


def quality_scores(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, held_out, score, predicted; learned from rows whose id's crc32 modulo 5 is not 0."""
    model = fit(docs, labels.filter(id_remainder(F.col("doc_id"), 5) != 0), "quality", train_docs)
    held = F.coalesce(id_remainder(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out")
    return score(docs.select("doc_id", held, "text"), model).select("doc_id", "held_out", "score", "predicted")
