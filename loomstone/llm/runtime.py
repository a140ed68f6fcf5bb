"""Shared-folder tables, input reading and connected components for the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a session on one machine gets a temporary one; on a
    cluster that is an error, as executors don't see each other's folders."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="loomstone-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/loomstone"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends there, and a
    lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession) -> None:
    """Sets Arrow batches of this session to 4 MB at most, so that a Python worker's memory follows from
    that bound and not from the number of rows; a longer text is a batch of its own."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, giving memory that it has freed back to the machine when it ends: Spark keeps Python workers for later
    tasks, and several of them share an executor's memory."""

    def wrapped(batches: Iterator) -> Iterator:
        import ctypes

        import pyarrow as pa

        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (AttributeError, OSError):  # another C library: it keeps what it keeps
                pass

    return wrapped


def partitions(spark: SparkSession, size: int, each: int) -> int:
    """Partitions for size bytes, so that each has `each` at most on average: no fewer than spark.sql.shuffle.partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // each))


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a text column; sizes blocks, so that they don't grow with the table."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for the nodes of links (a, b); component is the smallest node reachable.

    Alternating large-star and small-star steps: each keeps one edge per node and neighbour
    minimum, so the edge table never grows, and paths shorten by a constant factor per round.
    Ends when a round changes nothing. No nodes: no rows.
    """
    edges = materialise(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-edges"
    )
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        after = materialise(small, f"{name}-edges")
        mark = [F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")]
        was, now = edges.agg(*mark).first(), after.agg(*mark).first()
        edges = after
        if was == now:
            break
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")
