"""Document fingerprints by content-defined chunking.

A gear hash over the last 16 bytes marks places to cut. Chunk sizes are normalised: no cut below
MIN bytes, a strict condition up to NORMAL, a loose one after it, and a cut at MAX. As each hash
sees only its own chunk, an insertion moves the cuts around it and no others. The fingerprint
is the set of chunk digests with the chunks' lengths; the share of length in common digests, of the
smaller set, measures containment.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstone.llm.hashing import U, blocks, mix, span_hashes
from loomstone.llm.runtime import lean, partitions, small_batches, text_bytes

MIN, NORMAL, MAX, STRICT_BITS, LOOSE_BITS = 16, 32, 128, 6, 4
_GEAR = (mix(np.arange(256, dtype=U)) >> U(48)).astype(np.uint16)
_BLOCK_BYTES = 1_000_000
#: Bytes of text in one block of the order of documents.
ORDER_BYTES = 32_000_000


def _gear(data: np.ndarray) -> np.ndarray:
    """At i the gear hash after byte i: each byte's table value shifted once for every later byte,
    in 16 bits, so that the last 16 bytes count. Doubling the window takes four steps."""
    h = _GEAR[data]
    for width in (1, 2, 4, 8):
        h[width:] += h[:-width] << np.uint16(width)
    return h


def chunk_sets(texts: Sequence[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(sorted distinct 32-bit digests, chunk lengths) of each text."""
    out = []
    for a, b in blocks([len(t) for t in texts], _BLOCK_BYTES):
        data = np.frombuffer(b"".join(texts[a:b]), np.uint8)
        h = _gear(data)
        strict = (np.flatnonzero(h >> np.uint16(16 - STRICT_BITS) == 0) + 1).tolist()
        loose = (np.flatnonzero(h >> np.uint16(16 - LOOSE_BITS) == 0) + 1).tolist()
        strict.append(len(data) + MAX)
        loose.append(len(data) + MAX)
        starts, counts, start = [], [], 0
        for t in texts[a:b]:
            end, held, at = start + len(t), len(starts), start
            while at < end:
                starts.append(at)
                cut = strict[bisect_left(strict, at + MIN)]
                if cut >= at + NORMAL:
                    cut = min(loose[bisect_left(loose, at + NORMAL)], at + MAX)
                at = min(cut, end)
            counts.append(len(starts) - held)
            start = end
        first = np.array(starts, np.int64)
        last = np.append(first[1:], len(data))[: len(first)]
        digest, length = (span_hashes(data, first, last) >> U(32)).astype(np.uint32), last - first
        at = 0
        for n in counts:
            own, place = np.unique(digest[at : at + n], return_index=True)
            out.append((own, length[at : at + n][place]))
            at += n
    return out


def written(chunks: tuple[np.ndarray, np.ndarray]) -> str:
    """The fingerprint as text: for each chunk its digest, 8 hex digits, and its length in hex."""
    return " ".join(f"{d:08x}{n:x}" for d, n in zip(chunks[0].tolist(), chunks[1].tolist(), strict=True))


def read(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    parts = fingerprint.split()
    return np.array([int(x[:8], 16) for x in parts], np.uint32), np.array([int(x[8:], 16) for x in parts], np.int64)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Length in common digests by the smaller total length, 0 to 1. Two empty sets: 1; one: 0."""
    least = min(a[1].sum(), b[1].sum())
    if not least:
        return float(len(a[0]) == len(b[0]))
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    return float(min(1.0, np.minimum(a[1][i], b[1][j]).sum() / least))


@F.pandas_udf(T.StringType())
def fingerprint(texts: pd.Series) -> pd.Series:
    """The fingerprint of a text column (null: that of an empty text, the empty string)."""
    return pd.Series([written(x) for x in chunk_sets([(t or "").encode() for t in texts])])


@F.pandas_udf(T.DoubleType())
def containment(a: pd.Series, b: pd.Series) -> pd.Series:
    """likeness() of two fingerprint columns."""
    return pd.Series([likeness(read(x or ""), read(y or "")) for x, y in zip(a, b, strict=True)], dtype="float64")


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by as much of the beginning of the following one."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


#: Blocks at most: the driver holds a cut, and a first document's id and hash, for each.
MOST_BLOCKS = 100_000


def in_order(docs: DataFrame) -> DataFrame:
    """(block, copy, id, text): documents by descending id, then by hash and text, cut into blocks of about ORDER_BYTES (more, if there
    would be over MOST_BLOCKS).

    Each block ends with copies of the first document of the next block (after the last: of the
    first), so that every document meets its follower in its own block. Cuts are places in the order of ids; an id that would
    fill a block or more by itself (null, say) is cut by the hash of its texts as well. Equal rows can't be cut.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    n = min(MOST_BLOCKS, partitions(spark, text_bytes(rows), ORDER_BYTES))
    total = rows.count()
    hot = dict(rows.groupBy("id").agg(F.count("*").alias("c")).where(F.col("c") > max(2, total // n)).select("id", F.ceil(F.col("c") * n / max(1, total)).cast("int")).collect())
    cuts = rows.agg(F.percentile_approx("id", [(i + 1) / n for i in range(n - 1)] or [0.5], MOST_BLOCKS)).first()[0] or []
    cuts = np.unique(np.array([*cuts, *hot, *(i - 1 for i in hot if i > -(2**63))], np.int64))
    width = np.ones(len(cuts) + 1, np.int64)
    for i, k in hot.items():
        width[np.searchsorted(cuts, i, side="left")] = k
    first_block = np.cumsum(width) - width

    def numbered(ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Blocks count upward with ids and, within a cut id, downward with hashes: the order runs from the last block to the first."""
        at = np.searchsorted(cuts, ids, side="left")
        share = (hashes.astype(np.uint64) + np.uint64(1 << 63)) >> np.uint64(32)
        inner = (share * width[at].astype(np.uint64)) >> np.uint64(32)
        return first_block[at] + width[at] - 1 - inner.astype(np.int64)

    @F.pandas_udf("int")
    def block_of(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series(numbered(ids.to_numpy(), hashes.to_numpy()).astype(np.int32))

    heads = rows.select("id", "h").groupBy(block_of("id", "h").alias("b")).agg(F.max(F.struct("id", F.bitwise_not("h").alias("h"))).alias("m"))
    first = {r.b: (r.m.id, ~r.m.h) for r in heads.collect()}
    full = sorted(first)
    follower = {first[full[k - 1]]: full[k] for k in range(len(full))}  # k - 1 = -1: the order's first document follows its last

    @F.pandas_udf("array<struct<block:int,copy:int>>")
    def places(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        own = numbered(ids.to_numpy(), hashes.to_numpy())
        return pd.Series([[{"block": int(b), "copy": 0}, *([{"block": follower[k], "copy": 1}] if k in follower else [])] for k, b in zip(zip(ids.tolist(), hashes.tolist(), strict=True), own, strict=True)])

    spread = rows.withColumn("at", F.explode(places("id", "h"))).select("at.block", "at.copy", "id", "h", "text")
    # One partition for each block, so that none gets several.
    dealt = spread.repartitionById(max(full, default=0) + 1, "block").sortWithinPartitions("copy", F.desc("id"), "h", "text")
    return dealt.select("block", "copy", "id", "text")


def compare(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the one that follows by descending doc_id, ties by the text's hash and the text, null ids last;
    after the last comes the first, and a single document follows itself. Null texts are empty. A very long text is
    held whole, with its follower, by one task. An empty table gives no rows; further columns are ignored.
    """
    import hashlib

    small_batches(docs.sparkSession)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, str, str]]]:
        waits = None  # the document whose follower is to come
        for batch in batches:
            found = []
            for block, copy, i, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if waits and waits[0] == block:
                    found.append((waits[1], waits[2], text))
                    waits = None
                if not copy:
                    waits = (block, i, text)
            yield found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in pairs(batches):
            texts = [t for _, t, _ in found]
            follows = list(range(1, len(found) + 1))
            extra = []
            for k, (_, _, following) in enumerate(found):
                if k + 1 == len(found) or texts[k + 1] is not following:
                    follows[k] = len(texts) + len(extra)
                    extra.append(following)
            changed = [edited(t, f) for _, t, f in found]
            sets = chunk_sets([t.encode() for t in [*texts, *extra, *changed]])
            other = sets[len(texts) + len(extra) :]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([None if i == -(2**63) else i for i, _, _ in found], pa.int64()),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
                    pa.array([written(x) for x in sets[: len(texts)]], pa.string()),
                    pa.array([written(x) for x in other], pa.string()),
                    pa.array([likeness(sets[k], x) for k, x in enumerate(other)], pa.float64()),
                    pa.array([likeness(sets[k], sets[j]) for k, j in enumerate(follows)], pa.float64()),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return in_order(docs).mapInArrow(lean(run), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
