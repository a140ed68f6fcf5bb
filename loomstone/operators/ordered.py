"""Operators over ordered rows: carried state, deltas, runs, chunks and trailing means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.functions.scalar import zigzag


def carried(df: DataFrame, key: str, order: str, state: Column, name: str) -> DataFrame:
    """The last state that is not null among the rows before, for each key."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_state", state).withColumn(name, F.last("_state", ignorenulls=True).over(before)).drop("_state")


def deltas(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """delta to the row before of the key (the first: its value), zz: the delta as zigzag, and restored: their running sum."""
    w = Window.partitionBy(key).orderBy(order)
    out = df.withColumn("delta", F.col(value) - F.coalesce(F.lag(value).over(w), F.lit(0)))
    return out.withColumn("zz", zigzag(F.col("delta"))).withColumn("restored", F.sum("delta").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def runs(df: DataFrame, key: str, order: str, value: str, least: int = 2) -> DataFrame:
    """(key, value, first, last, n): runs of `least` or more consecutive rows of a key with one value."""
    w = Window.partitionBy(key).orderBy(order)
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    numbered = df.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    grouped = numbered.groupBy(key, "_run").agg(F.first(value).alias(value), F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))
    return grouped.where(F.col("n") >= least).drop("_run")


def chunk_starts(length: Column, every: int) -> Column:
    """Starts of fixed-stride chunks of a stream of this length (none for an empty one)."""
    return F.when(length > 0, F.sequence(F.lit(0).cast("long"), F.floor((length - 1) / every) * every, F.lit(every).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def context_frame(start: Column, block: int) -> Column:
    """struct(first, context) of a chunk: its first predicted place (1 at the stream's start) and where its context begins."""
    first = F.when(start == 0, F.lit(1).cast("long")).otherwise(start)
    return F.struct(first.alias("first"), F.greatest(F.lit(0).cast("long"), first - block).alias("context"))


def training_frame(end: Column, block: int) -> Column:
    """struct(x, y): starts of the last min(block, end - 1) places before end, and of what follows each; null below two places."""
    size = F.least(F.lit(block).cast("long"), end - 1)
    return F.when(end >= 2, F.struct((end - size - 1).alias("x"), (end - size).alias("y")))


def replay_end(end: Column, step: Column, block: int) -> Column:
    """Where a replayed window ends: at end for step 0, else a place from block + 1 to end that end and step decide."""
    least = F.lit(block + 1).cast("long")
    return F.when((step == 0) | (least >= end), end).otherwise(least + F.pmod(end * 31 + step * 1_000_003, end - least + 1))


def total_rank(df: DataFrame, order: Sequence[Column], path: str) -> DataFrame:
    """df with place, 0, 1, ... over all rows in this order. Rows are dealt into range partitions and written to path; only the
    partitions' counts are summed in one place. Rows equal in `order` get places in no set order."""
    spark = df.sparkSession
    df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    parts = spark.read.parquet(path)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))  # a row for each partition
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return parts.withColumn("_in", inside).join(starts, "_part").withColumn("place", F.col("_start") + F.col("_in")).drop("_part", "_in", "_start")
