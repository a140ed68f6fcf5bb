"""Frequency-ranked dictionaries and coding with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked(items: DataFrame, key: str, seen: str, most: int, least: int = 2) -> DataFrame:
    """(key, cnt, first_seen, rank): keys that occur `least` times or more, ranked by count, then by where they were
    first seen, cut to `most`. Counting is distributed; only the cut's few rows are numbered together."""
    counted = items.groupBy(key).agg(F.count("*").alias("cnt"), F.min(seen).alias("first_seen")).where(F.col("cnt") >= least)
    top = counted.orderBy(F.desc("cnt"), "first_seen", key).limit(most)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("cnt"), "first_seen", key)) - 1)


def coded(items: DataFrame, dictionary: DataFrame, key: str) -> DataFrame:
    """items with rank (null: not in the dictionary) and bytes: 2 for a rank, 2 and its own for a literal.
    The dictionary is broadcast: its size is bounded by its cut."""
    joined = items.join(F.broadcast(dictionary.select(key, "rank")), key, "left")
    return joined.withColumn("bytes", F.when(F.col("rank").isNotNull(), 2).otherwise(F.octet_length(key) + 2))
