"""Contiguous shards of near equal byte size, from global prefix sums cut at equal targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm.prefix import prefix_sums


def shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null) for each row.

    A row's size is its text's UTF-8 bytes plus 1 (null text: 1). Rows are ordered by doc_id,
    nulls last, then checksum and size; rows that still tie are equal in all that is returned. A row goes to the
    shard in whose equal share of all bytes its middle byte lies, so a shard's size is off by
    less than the largest row. slot counts a shard's rows from 0. Equal texts are spread like
    any rows, and only (doc_id, size, checksum) is shuffled. With fewer rows than shards some
    shards are empty; an empty table gives no rows. Further columns are ignored.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    order = [F.col("doc_id").asc_nulls_last(), F.col("text_crc32"), F.col("size")]
    placed = prefix_sums(rows, [], order, {"bytes_before": F.col("size"), "rows_before": F.lit(1)}, "shards")
    total = placed.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    middle = (2 * F.col("bytes_before") + F.col("size")).cast("decimal(38,0)") * shards
    cut = placed.withColumn("shard", F.floor(middle / F.lit(max(1, 2 * total))).cast("int"))
    # One row for each shard, so its size has a bound.
    first = F.broadcast(cut.groupBy("shard").agg(F.min("rows_before").alias("first_row")))
    return cut.join(first, "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rows_before") - F.col("first_row")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
