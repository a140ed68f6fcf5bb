"""The queries op1 to op10 over the tables of a folder, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomstone.llm import bpe, fingerprint, jaccard, line_dedup, mixing, neighbours, quality, sharding, token_files, toxicity
from loomstone.llm.runtime import documents, labels


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(documents(spark, sf_dir))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir))


def op9_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(documents(spark, sf_dir))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir), labels(spark, sf_dir))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(documents(spark, sf_dir), labels(spark, sf_dir))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(documents(spark, sf_dir))


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare(documents(spark, sf_dir))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search_fiftieths(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.digest(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_ngram_jaccard_join, op3_byte_bpe, op4_document_fingerprints, op5_line_dedup, op6_token_files, op7_sharding, op8_quality_classifier, op9_mixing_sources, op10_nearest_neighbours,)}


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_jaccard_join": jaccard.ORACLE_SQL, "op5_line_dedup": line_dedup.ORACLE_SQL}
