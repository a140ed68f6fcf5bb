"""Byte-level BPE encoding and decoding with the ranks of a vocabulary file.

Long texts are cut, in one pass, into overlapping chunks, which are pre-tokenised in parallel, each from its
own start. A chunk's pre-token boundaries and those of the chunk before it agree from some
point in their overlap on; there the two are stitched. What lies between two stitches is a piece of one chunk; the
pieces are encoded in parallel, and give the ids of the whole text. Decoding concatenates the ids' raw bytes.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.llm.runtime import lean, materialise, partitions, small_batches, text_bytes

#: Code points of a chunk, and how many more it reads into the next.
CHUNK, OVERLAP = 32_768, 1_024
#: Chunks that the task that cuts a text holds at once, and bytes of chunks in a partition.
_HELD, _PART_BYTES = 32, 64_000_000


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def defaults() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def boundaries(text: str, pattern: str) -> np.ndarray:
    """Ends of pre-tokens that a piece of the text may end at.

    An end after white space is left out: at the end of a piece the pattern would take the white
    space together. The text's own end is left out too, as the text may go on.
    """
    import regex

    ends = (m.end() for m in regex.finditer(pattern, text))
    return np.array([e for e in ends if e < len(text) and not text[e - 1].isspace()], np.int64)


def _encode(path: str, pattern: str, raw: bool):
    @F.pandas_udf("ids array<int>, raw binary" if raw else "ids array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        def go(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            own = encoding(path, pattern)
            for texts in batches:
                ids = [own.encode_to_numpy(t, disallowed_special=()).view(np.int32) for t in texts]
                out = pd.DataFrame({"ids": pd.Series(ids, dtype=object)})
                yield out.assign(raw=pd.Series([own.decode_bytes(x.tolist()) for x in ids], dtype=object)) if raw else out

        yield from lean(go)(batches)

    return run


def _chunks(long: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(doc, hash, n, k, piece): the overlapping chunks of each (doc, hash, n, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                doc, key, n, text = (batch.column(j)[i].as_py() for j in range(4))
                for first in range(0, -(-n // chunk), _HELD):
                    ks = list(range(first, min(first + _HELD, -(-n // chunk))))
                    m = len(ks)
                    yield pa.RecordBatch.from_arrays([pa.array([doc] * m, pa.int64()), pa.array([key] * m, pa.int64()), pa.array([n] * m, pa.int32()), pa.array(ks, pa.int32()), pa.array([text[k * chunk : (k + 1) * chunk + overlap] for k in ks], pa.string())], ["doc", "hash", "n", "k", "piece"])

    return long.mapInArrow(lean(run), "doc long, hash long, n int, k int, piece string")


def _sync_points(chunks: DataFrame, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """(doc, hash, n, k, head, tail): the boundaries of each chunk in its overlap with either neighbour."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [boundaries(t, pattern) + k * chunk for k, t in zip(pdf["k"], pdf["piece"], strict=True)]
            near = [[b[(b >= x * chunk) & (b < x * chunk + overlap)] for b, x in zip(found, pdf["k"] + step, strict=True)] for step in (0, 1)]
            yield pdf.drop(columns="piece").assign(head=near[0], tail=near[1])

    return chunks.mapInPandas(lean(run), "doc long, hash long, n int, k int, head array<long>, tail array<long>")


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP, raw: bool = False) -> DataFrame:
    """docs with ids, an array of the text's token ids, and with raw, if asked for: the bytes that they decode to.

    A null or empty text has no ids. Every match of pattern is encoded on its own, no special tokens. A text of any
    length is scanned once by the task that cuts it; where two chunks have no common boundary in
    their overlap (a run of letters longer than it, say) the whole text is one piece. Further columns stay (those named ids, or
    raw, are replaced); an empty table gives no rows; rows that repeat keep a row each.
    """
    spark, new = docs.sparkSession, ["ids", "raw"] if raw else ["ids"]
    path, pattern = path or defaults()[0], pattern or defaults()[1]
    small_batches(spark)
    run = _encode(path, pattern, raw)
    # The caller's columns travel in a struct, so that none can clash with those made here.
    packed = docs.drop(*new).select(F.struct("*").alias("_row"))
    text = F.coalesce(F.col("_row.text"), F.lit(""))
    short = packed.where(F.char_length(text) <= chunk).withColumn("_coded", run(text))
    own = packed.where(F.char_length(text) > chunk).select("_row", F.coalesce(F.col("_row.doc_id").cast("long"), F.lit(-1)).alias("_doc"), F.xxhash64(text).alias("_hash"), F.char_length(text).alias("_n"))
    # Rows with the same id and text have the same ids: one of them is cut into chunks.
    key = ["doc", "hash", "n"]
    long = own.select(F.col("_doc").alias("doc"), F.col("_hash").alias("hash"), F.col("_n").alias("n"), F.col("_row.text").alias("text")).dropDuplicates(key)
    n = partitions(spark, text_bytes(packed.select(F.when(F.char_length(text) > chunk, text).alias("text"))), _PART_BYTES)
    chunks = materialise(_chunks(long, chunk, overlap).repartition(n, *key, "k"), "bpe-chunks")
    order = Window.partitionBy(*key).orderBy("k")
    sync = F.when(F.col("k") == 0, F.lit(0).cast("long")).otherwise(F.array_min(F.array_intersect(F.lag("tail").over(order), "head")))
    cuts = _sync_points(chunks, pattern, chunk, overlap).withColumn("at", sync).select(*key, "k", "at")
    cuts = materialise(cuts.withColumns({"end": F.coalesce(F.lead("at").over(order), F.col("n").cast("long")), "torn": F.max(F.col("at").isNull()).over(Window.partitionBy(*key))}), "bpe-cuts")
    start = F.col("at") - F.col("k") * chunk
    pieces = chunks.join(cuts.where("not torn"), [*key, "k"]).select(*key, "k", F.substring(F.col("piece"), (start + 1).cast("int"), (F.col("end") - F.col("at")).cast("int")).alias("piece"))
    whole = long.join(cuts.where("torn and k = 0").select(*key), key).select(*key, F.lit(0).alias("k"), F.col("text").alias("piece"))
    coded = pieces.unionByName(whole).repartition(n, *key, "k").select(*key, "k", run(F.col("piece")).alias("c"))
    parts = F.array_sort(F.collect_list(F.struct("k", "c.*")))
    coded = coded.groupBy(*key).agg(parts.alias("p"))
    joined = {"ids": F.flatten(F.transform("p", lambda x: x["ids"])), "raw": F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["raw"])), ""))}
    coded = coded.select(*key, F.struct(*[joined[c].alias(c) for c in new]).alias("_coded"))
    found = own.join(coded, (F.col("_doc") == F.col("doc")) & (F.col("_hash") == F.col("hash")) & (F.col("_n") == F.col("n")))
    return short.unionByName(found.select("_row", "_coded")).select("_row.*", "_coded.*")


def decode(ids: Column, path: str | None = None) -> Column:
    """The raw bytes of an array of ids (null: empty); they need not be valid UTF-8. An id that has no token is an error."""
    path, pattern = path or defaults()[0], defaults()[1]

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = encoding(path, pattern)
        for rows in batches:
            yield pd.Series([b"" if x is None else own.decode_bytes(x.tolist()) for x in rows], dtype=object)

    return run(ids)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row."""
    coded = encode(docs.select("doc_id", "text"), raw=True)
    listed = F.array_join(F.transform("ids", lambda x: x.cast("string")), ",")
    return coded.select(F.col("doc_id").cast("long").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"), F.sha2("raw", 256).alias("decoded_sha256"))
