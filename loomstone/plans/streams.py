"""Framed and coded streams, scans of symbols, and packed channels with an index."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstone.functions.binary import byte_at
from loomstone.plans.coding import decode_by_counts, encode_by_counts
from loomstone.plans.registry import query
from loomstone.sources.frames import read_frames, write_frames
from loomstone.sources.shared import scratch
from loomstone.sources.tables import table

_TURNS = "SELECT conv_id::VARCHAR AS stream, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS seq, text FROM conversations"


def _turns(spark: SparkSession, folder: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn", "text")
    return table(spark, folder, "conversations").select(F.col("conv_id").cast("string").alias("stream"), (F.row_number().over(w) - 1).cast("long").alias("seq"), F.encode("text", "UTF-8").alias("payload"))


@query(f"SELECT stream, seq, strlen(text) AS bytes, sha256(text) AS sha256 FROM ({_TURNS})")
def q_frames(spark: SparkSession, folder: str) -> DataFrame:
    """Turns of conversations as framed streams, written and read back."""
    path = scratch(spark, "frames")
    write_frames(_turns(spark, folder), path)
    return read_frames(spark, path).select("stream", "seq", F.octet_length("payload").cast("long").alias("bytes"), F.sha2("payload", 256).alias("sha256"))


@query(f"SELECT stream, count(*) AS segments, CAST(sum(strlen(text)) AS BIGINT) AS bytes, true AS same, sha256(string_agg(sha256(text), '' ORDER BY seq)) AS chain FROM ({_TURNS}) GROUP BY stream")
def q_coded_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Streams coded segment by segment into frames, with each segment's length, and decoded from the frames alone; segments and bytes
    are counted against the source, and the segments' hashes are hashed in order."""
    path = scratch(spark, "coded")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(payload=[struct.pack("<Q", len(x)) + c for x, c in zip(pdf["payload"], encode_by_counts(list(pdf["payload"])), strict=True)])

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(payload=decode_by_counts([x[8:] for x in pdf["payload"]], [struct.unpack_from("<Q", x)[0] for x in pdf["payload"]]))

    own = _turns(spark, folder)
    kind = "stream string, seq long, payload binary"
    write_frames(own.mapInPandas(encode, kind), path)
    found = read_frames(spark, path).mapInPandas(decode, kind)
    chain = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.sha2("payload", 256).alias("h")))), lambda x: x["h"]), "").cast("binary"), 256)
    read = found.groupBy("stream").agg(F.count("*").alias("segments"), F.sum(F.octet_length("payload")).alias("bytes"), chain.alias("chain"))
    wanted = own.groupBy("stream").agg(F.count("*").alias("n"), F.sum(F.octet_length("payload")).alias("b"))
    return wanted.join(read, "stream", "left").select("stream", "segments", "bytes", F.coalesce((F.col("n") == F.col("segments")) & (F.col("b") == F.col("bytes")), F.lit(False)).alias("same"), "chain")


@query("""SELECT doc_id, i AS pos, CAST(('0x' || substr(h, 2 * i + 1, 2)) AS INTEGER) AS sym FROM (SELECT doc_id, h, unnest(range(least(64, length(h) // 2))) AS i FROM (SELECT doc_id, hex(encode(text)) AS h FROM documents))""")
def q_symbol_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The first 64 symbols of each stream with their places: the limit is the feature, and cuts before anything is unpacked. A symbol
    out of the alphabet is an error."""
    head = F.substring(F.encode("text", "UTF-8"), 1, 64)
    rows = table(spark, folder, "documents").select("doc_id", head.alias("raw")).where(F.octet_length("raw") > 0)
    spread = rows.select("doc_id", "raw", F.explode(F.sequence(F.lit(0).cast("long"), F.octet_length("raw").cast("long") - 1)).alias("pos"))
    sym = byte_at(F.col("raw"), (F.col("pos") + 1).cast("int")).cast("int")
    return spread.select("doc_id", "pos", F.when(sym.between(0, 255), sym).otherwise(F.raise_error(F.lit("a symbol is out of the alphabet")).cast("int")).alias("sym"))


#: The mark of a packed blob.
MARK = b"LPK1"


def _pack(parts: list[tuple[str, int, bytes]]) -> bytes:
    index = json.dumps([{"name": n, "bits": b, "length": len(x)} for n, b, x in parts]).encode()
    return zlib.compress(MARK + struct.pack("<I", len(index)) + index + b"".join(x for _, _, x in parts))


def _unpack(blob: bytes) -> list[tuple[str, int, bytes]]:
    """The parts of a blob; another mark, and anything after the last part, is an error."""
    raw = zlib.decompress(blob)
    if raw[:4] != MARK:
        raise ValueError("a packed blob has another mark")
    size, out = struct.unpack_from("<I", raw, 4)[0], []
    at = 8 + size
    for entry in json.loads(raw[8:at]):
        out.append((entry["name"], entry["bits"], raw[at : at + entry["length"]]))
        at += entry["length"]
    if at != len(raw):
        raise ValueError(f"a packed blob ends at {at} of {len(raw)} bytes")
    return out


@query("""WITH q AS (SELECT vec_id, vec_id % 3 + 2 AS bits, list_transform(embedding, lambda e: CAST(floor((greatest(-1, least(1, CAST(e AS DOUBLE))) + 1) / 2 * (pow(2, vec_id % 3 + 2) - 1) + 0.5) AS BIGINT)) AS codes FROM embeddings),
e AS (SELECT vec_id, unnest([2, 3, 4]) AS bits FROM embeddings)
SELECT e.vec_id, CAST(e.bits AS INTEGER) AS bits, coalesce(len(codes), 0) AS codes, CAST(coalesce(list_sum(codes), 0) AS BIGINT) AS total FROM e LEFT JOIN q ON q.vec_id = e.vec_id AND q.bits = e.bits""")
def q_packed_channels(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors' codes packed with an index by name and bits, unpacked, and joined to all that could be there: what is missing is empty."""
    bits = (F.col("vec_id") % 3 + 2).cast("int")
    code = lambda e: F.floor((F.greatest(F.lit(-1.0), F.least(F.lit(1.0), e.cast("double"))) + 1) / 2 * (F.pow(F.lit(2.0), bits) - 1) + 0.5).cast("int")
    rows = table(spark, folder, "embeddings").select("vec_id", bits.alias("bits"), F.transform("embedding", code).alias("codes"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:  # a blob for each batch
            yield pd.DataFrame({"blob": [_pack([(str(n), b, np.asarray(c, np.uint8).tobytes()) for n, b, c in zip(pdf["vec_id"], pdf["bits"], pdf["codes"], strict=True)])]})

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for blob in pdf["blob"]:
                parts = _unpack(blob)
                yield pd.DataFrame({"vec_id": [int(n) for n, _, _ in parts], "bits": [b for _, b, _ in parts], "codes": [np.frombuffer(x, np.uint8).astype(np.int64) for _, _, x in parts]})

    found = rows.mapInPandas(pack, "blob binary").mapInPandas(unpack, "vec_id long, bits int, codes array<long>")
    every = rows.select("vec_id", F.explode(F.array(*map(F.lit, (2, 3, 4)))).alias("bits"))
    codes = F.coalesce("codes", F.array().cast("array<bigint>"))
    joined = every.join(found, ["vec_id", "bits"], "left").select("vec_id", "bits", codes.alias("codes"))
    return joined.select("vec_id", "bits", F.size("codes").cast("long").alias("codes"), F.aggregate("codes", F.lit(0).cast("long"), lambda s, v: s + v).alias("total"))
