"""Registered queries of the training-data operators and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm import centroids, chunking, langid, lexical, minhash, mixing, multi_index, pii, quality, simhash, tiling, tokens, toxicity
from furrow.llm.common import read_table
from furrow.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document, weights 1, 2, 3 by source, at most three epochs."""
    return mixing.mix_plan(read_table(spark, sf_dir, "documents"), cycle=(1, 2, 3), cap=3)


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by rank-order profiles."""
    return langid.identify(read_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chained category probabilities and the toxic flag of every document."""
    return toxicity.toxicity_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def vocabulary() -> str:
    """Place of the public vocabulary that the token query is defined with."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: base spans, and those that the boosted trees add."""
    return pii.personal_data(read_table(spark, sf_dir, "documents"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document, of its edited text, and their likeness."""
    return minhash.compare_with_next(read_table(spark, sf_dir, "documents"))


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written as seekable files and read back from them."""
    folder = scratch_path(spark, "tokens")
    tokens.write_tokens(read_table(spark, sf_dir, "documents"), folder, vocabulary(), end_id=2)
    return tokens.read_tokens(spark, folder)


def op7_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the benchmark items that they contain, in whatever order of passages."""
    return tiling.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("text_hash")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.simhash_components(read_table(spark, sf_dir, "documents"), words=4, radius=4)


def op9_chunking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that occur more than once, in every document that has them."""
    return chunking.repeated_passages(read_table(spark, sf_dir, "documents")).drop("text_hash")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by supervised subword embeddings."""
    return quality.quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every whole vector after ten rounds with eight centroids."""
    return centroids.clustered(read_table(spark, sf_dir, "embeddings"), clusters=8, rounds=10, dim=64, scale=1024, seed=3)


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents that rank highest for each benchmark item."""
    return lexical.ranked(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), k=10)


def op13_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors found for every fiftieth vector."""
    return multi_index.nearest(read_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


def queries() -> dict[str, Query]:
    return {
        "op1_mixing": op1_mixing, "op2_langid": op2_langid, "op3_toxicity": op3_toxicity, "op4_pii": op4_pii, "op5_minhash": op5_minhash, "op6_tokens": op6_tokens, "op7_tiling": op7_tiling,
        "op8_simhash": op8_simhash, "op9_chunking": op9_chunking, "op10_quality": op10_quality, "op11_centroids": op11_centroids, "op12_lexical": op12_lexical, "op13_multi_index": op13_multi_index,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": mixing.MIX_SQL, "op11_centroids": centroids.cluster_sql(), "op12_lexical": lexical.RANKED_SQL}
