"""Parquet tables of a folder, and byte files with trailers and frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.functions.binary import from_le, to_le
from loomstone.functions.scalar import let


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def byte_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, content) of whole files, found below path."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "length", "content")


def append_trailer(content: Column, trailer: Column, magic: str) -> Column:
    """content + trailer + 8-byte magic + the trailer's length; content that ends in such a footer stays."""
    footer = F.concat(F.lit(magic).cast("binary"), to_le(F.octet_length(trailer), 8))
    return F.when(has_trailer(content, magic), content).otherwise(F.concat(content, trailer, footer))


def has_trailer(content: Column, magic: str) -> Column:
    tail = F.substring(content, F.octet_length(content) - 15, F.lit(8))
    return (F.octet_length(content) >= 16) & (tail == F.lit(magic).cast("binary"))


def split_trailer(content: Column, magic: str) -> Column:
    """struct(body, trailer) of content; trailer is null where there is none. A length that exceeds the file is an error."""
    n = F.octet_length(content)
    wrong = F.raise_error(F.lit("the trailer is longer than the file")).cast("struct<body:binary,trailer:binary>")

    def split(size: Column) -> Column:
        parts = F.struct(F.substring(content, F.lit(1), (n - 16 - size).cast("int")).alias("body"), F.substring(content, (n - 15 - size).cast("int"), size.cast("int")).alias("trailer"))
        return F.when(size <= n - 16, parts).otherwise(wrong)

    without = F.struct(content.alias("body"), F.lit(None).cast("binary").alias("trailer"))
    return F.when(has_trailer(content, magic), let(from_le(content, n - 7, 8), split)).otherwise(without)
