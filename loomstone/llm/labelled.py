"""A bounded sample of labelled documents, and the held-out rule, shared by the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out() -> Column:
    """Whether crc32 of doc_id as text leaves 0 modulo 5; a null doc_id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, text, y) of at most `most` labelled documents that aren't held out.

    They are those with the smallest hash of doc_id, so reruns agree. A doc_id labelled more than
    once counts with its largest label, one with several texts with the smallest text; null labels don't count. So the
    sample has `most` rows at most, whole texts of any length. Only this bounded list of ids is broadcast; the texts are read where they
    lie.
    """
    own = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).where(~held_out())
    own = own.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    chosen = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y")
