"""Corpus preparation in five stages, each over all that the stage before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's documents.  All stages but the last return
the columns of documents; the last returns a row per document of the token files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm import langid, mixing, simhash, tiling, tokens
from furrow.llm.common import bounded_batches, read_table
from furrow.llm.queries import vocabulary
from furrow.session import cut_lineage, scratch_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language; null texts, texts without letters and unrecognized ones go."""
    bounded_batches(spark)
    return langid.with_language(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    bounded_batches(spark)
    return simhash.near_unique(docs, words=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    bounded_batches(spark)
    return tiling.clean_documents(docs, read_table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the numbers that the sources' weights ask for; ``n_chars`` follows a cut text."""
    bounded_batches(spark)
    mixed = mixing.mixed_documents(docs)
    return mixed.withColumn("n_chars", F.length("text").cast(mixed.schema["n_chars"].dataType))


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, and what is read back from them."""
    bounded_batches(spark)
    folder = scratch_path(spark, "tokens")
    tokens.write_tokens(docs, folder, vocabulary(), end_id=2)
    return tokens.read_tokens(spark, folder)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination), ("source_mix", source_mix), ("token_output", token_output)]

#: No SQL: profiles, fingerprints, tiles and token ids are beyond it; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return docs
