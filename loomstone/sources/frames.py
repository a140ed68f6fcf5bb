"""Streams of framed segments: each an 8-byte little-endian length and that many bytes.

A stream is a table of parts (stream, part, content): a part holds whole frames in order, so that writers and readers work on
parts side by side and none holds a stream.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.functions.binary import to_le

SCHEMA = "stream string, part long, first long, frames long, content binary"
#: Frames of a part.
PART_FRAMES = 64


def write_frames(segments: DataFrame, path: str, part_frames: int = PART_FRAMES) -> None:
    """Writes (stream, seq, payload), seq counting a stream's segments from 0. A gap in a part is an error."""
    framed = F.concat(F.hex(to_le(F.octet_length("payload"), 8)), F.hex("payload"))
    rows = segments.select("stream", F.floor(F.col("seq") / part_frames).alias("part"), "seq", framed.alias("f"))
    parts = rows.groupBy("stream", "part").agg(F.array_sort(F.collect_list(F.struct("seq", "f"))).alias("p"), F.min("seq").alias("first"), F.max("seq").alias("last"), F.count("*").alias("frames"))
    whole = F.when((F.col("last") - F.col("first") + 1 == F.col("frames")) & (F.col("first") == F.col("part") * part_frames), F.col("p")).otherwise(F.raise_error(F.lit("segments are missing or repeated")).cast(parts.schema["p"].dataType))
    parts.select("stream", "part", "first", "frames", F.unhex(F.array_join(F.transform(whole, lambda x: x["f"]), "")).alias("content")).write.mode("errorifexists").parquet(path)


def split_frames(content: bytes) -> list[bytes]:
    """The payloads of whole frames; a truncated length or payload is an error."""
    out, at = [], 0
    while at < len(content):
        if len(content) - at < 8:
            raise ValueError("a frame's length is truncated")
        size = struct.unpack_from("<Q", content, at)[0]
        if size > len(content) - at - 8:
            raise ValueError("a frame is truncated")
        out.append(content[at + 8 : at + 8 + size])
        at += 8 + size
    return out


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """(stream, seq, payload) of a stream's parts, each read in one pass; a part with another number of frames than it says is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stream, first, frames, content in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                payloads = split_frames(content)
                if len(payloads) != frames:
                    raise ValueError(f"{stream}: {len(payloads)} frames in place of {frames}")
                yield pa.RecordBatch.from_arrays([pa.array([stream] * frames, pa.string()), pa.array(range(first, first + frames), pa.int64()), pa.array(payloads, pa.binary())], ["stream", "seq", "payload"])

    return spark.read.schema(SCHEMA).parquet(path).select("stream", "first", "frames", "content").mapInArrow(run, "stream string, seq long, payload binary")
