"""Language of documents by rank-order profiles.

A text's profile lists its most frequent letter n-grams (one to three letters, words
padded by a blank) by rank; a language's profile lists those of its training texts.
The out-of-place distance adds up how far each n-gram of the document stands
from its rank in the language, and the full profile length where it is absent.

The profiles are counted over whole texts of a bounded sample: ``TRAIN_DOCS``
documents of each language, taken by a hash.  Prediction sees the text alone.

Defined cases: a null text, or one without letters, is ``und`` with score 0; so is any text
if nothing could be learned; equal distances go to the language first in code
point order; rows with a null id, text or language are never learned from; repeated
rows give one result row each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.llm.common import byte_steps, checkpointed, id_remainder, unused, with_columns

#: Documents of each language that its profile is counted over.
TRAIN_DOCS = 1000
#: N-grams of a profile.
PROFILE = 300
#: More different labels than this are an error, since the profiles are sent to every task.
MAX_LANGUAGES = 1000
UNKNOWN = "und"
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Which code points are letters."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The letter n-grams of a whole text, ascending by code, and their counts."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    points = np.where(letters()[points], points, 1)
    points = np.concatenate(([1], points, [1]))
    points = points[np.concatenate(([True], (points[1:] != 1) | (points[:-1] != 1)))]
    if len(points) < 3:  # blanks only
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    one = points[points != 1]
    two = points[:-1] | points[1:] << 21
    three = points[:-2] | points[1:-1] << 21 | points[2:] << 42
    return np.unique(np.concatenate([one, two, three]), return_counts=True)


def top_grams(text: str | None, size: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams of a text by rank, ties by code."""
    grams, counts = gram_counts(text)
    return grams[np.argsort(-counts, kind="stable")[:size]]


@dataclass
class Profiles:
    """Ranks of n-grams (ascending codes) in every language, ``size`` where absent."""

    languages: list[str]
    grams: np.ndarray
    ranks: np.ndarray
    size: int

    def closest(self, text: str | None) -> tuple[str, float]:
        """Nearest language, and one minus its distance as a share of the greatest possible."""
        top = top_grams(text, self.size)
        if not len(top) or not self.languages:
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.grams, top), len(self.grams) - 1)
        ranks = np.where((self.grams[at] == top)[:, None], self.ranks[at], self.size)
        moved = np.where(ranks == self.size, self.size, np.abs(ranks - np.arange(len(top))[:, None])).sum(axis=0)
        best = int(np.argmin(moved))
        return self.languages[best], 1.0 - float(moved[best]) / (self.size * len(top))


def learn(labelled: DataFrame, train_docs: int = TRAIN_DOCS, size: int = PROFILE) -> Profiles:
    """Profiles of the languages in ``labelled`` (doc_id, text, lang without nulls)."""
    # Hashes below a share of four times the sample come first, so that few rows meet in a language's window.
    key = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    counts = checkpointed(labelled.groupBy("lang").count().limit(MAX_LANGUAGES + 1))
    if counts.count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    near = labelled.select("lang", "doc_id", "text").join(F.broadcast(counts), "lang").filter(key.cast("double") * F.col("count") < 4.0 * train_docs * (1 << 30))
    order = Window.partitionBy("lang").orderBy(key, "doc_id", "text")
    sample = near.select("lang", "text", F.row_number().over(order).alias("n")).filter(F.col("n") <= train_docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in byte_steps(batches):
            for lang, text in zip(piece.column("lang").to_pylist(), piece.column("text").to_pylist(), strict=True):
                grams, counts = gram_counts(text)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(grams), pa.string()), "gram": grams, "n": counts.astype(np.int64)})

    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")) - 1
    counted = sample.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rows = counted.withColumn("rank", rank).filter(F.col("rank") < size).select("lang", "gram", "rank").toPandas()  # a profile of each of the languages
    languages = sorted(rows["lang"].unique())
    grams = np.unique(rows["gram"].to_numpy(np.int64))
    ranks = np.full((len(grams), len(languages)), size, np.int64)
    number = {x: i for i, x in enumerate(languages)}
    ranks[np.searchsorted(grams, rows["gram"].to_numpy(np.int64)), [number[x] for x in rows["lang"]]] = rows["rank"].to_numpy(np.int64)
    return Profiles(languages, grams, ranks, size)


def predict(docs: DataFrame, profiles: Profiles, label: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the columns ``label`` and ``score`` (0 to 1) for every whole text; columns so named before are replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in byte_steps(batches):
            found = [profiles.closest(t) for t in piece.column("text").to_pylist()]
            yield with_columns(piece, names, **{label: pa.array([x for x, _ in found], pa.string()), score: pa.array([y for _, y in found], pa.float64())})

    names = [c for c in docs.columns if c not in (label, score)]
    slim = docs.select(*names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema)
    return slim.mapInArrow(run, f"{schema}, {label} string, {score} double")


def training_rows(docs: DataFrame) -> DataFrame:
    """Documents to learn from: those whose id's crc32 modulo 4 is not 2, with a text and a language."""
    return docs.filter((id_remainder(F.col("doc_id"), 4) != 2) & F.col("text").isNotNull() & F.col("lang").isNotNull())


def identify(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    profiles = learn(training_rows(docs), train_docs)
    held = F.coalesce(id_remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    slim = docs.select("doc_id", held.alias("held_out"), "text")
    return drop_text(predict(slim, profiles))


def drop_text(scored: DataFrame) -> DataFrame:
    return scored.select("doc_id", "held_out", "lang_pred", "score")


def with_language(docs: DataFrame, train_docs: int = TRAIN_DOCS, least: float = 0.0) -> DataFrame:
    """The documents of a known language: not ``und``, and with a score above ``least``: a text that shares no n-gram with any profile has 0.  Same columns as ``docs``."""
    profiles = learn(training_rows(docs), train_docs)
    label, score = unused(docs.columns, "lang_pred"), unused(docs.columns, "lang_score")
    known = predict(docs, profiles, label, score)
    return known.filter((F.col(label) != UNKNOWN) & (F.col(score) > least)).select(*[F.col(f"`{c}`") for c in docs.columns])
