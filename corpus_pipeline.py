"""From raw documents to token ids: five stages, each written and reread as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm import bpe, jaccard, line_dedup, mixing, quality
from loomstone.llm.runtime import documents, labels, materialise

#: Byte-level BPE, embeddings and the mix's draws have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose quality score is at least 0.3; rows that repeat share their score."""
    score = quality.score_quality(docs, labels(spark, sf_dir))
    return docs.where(score >= 0.3)


def line_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines out of texts; every row stays (null texts become empty), n_chars is counted anew."""
    kept = line_dedup.drop_repeated_lines(docs)
    return kept.select(*[F.char_length("text").cast(t).alias(c) if c == "n_chars" else F.col(c) for c, t in docs.dtypes])


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near duplicates the smallest doc_id. Rows that repeat a doc_id stay or
    go together; texts without words are nobody's duplicate and stay."""
    found = jaccard.near_duplicates(docs)
    gone = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone"]), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares. A row comes back once for each time that words of it are taken, with those words."""
    return mixing.mixed_documents(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids of each row, and whether the ids decode to its text."""
    coded = bpe.encode(docs, raw=True)
    same = F.col("raw") == F.coalesce("text", F.lit("")).cast("binary")
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("lossless"))


STAGES = [("quality", quality_filter), ("lines", line_filter), ("near_duplicates", near_duplicate_filter), ("mix", mix), ("tokens", tokenise)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to the documents of a folder.

    Rows with null, empty or very long texts, with a null or repeated doc_id, and further columns pass each stage as its own docstring
    says: quality scores them, lines and near duplicates keep those without words, the mix takes words alone, so that texts without any
    end there. An empty table gives no rows. Every stage but the last is written to the shared folder.
    """
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, f"stage-{name}")
    return docs
