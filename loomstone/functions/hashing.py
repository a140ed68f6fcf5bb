"""64-bit block features on uint64 arrays, as UDFs that give 16 hex digits (which sort as the numbers do)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstone.functions.scalar import let

#: Fixed values of the mixing function and the features.
GOLDEN, MIX_1, MIX_2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
KEY_BYTES, MARKER, MARKER_BYTES, PREFIX, PREFIX_LEAST = 16, 0xDF, 256, 12, 16
_U = np.uint64


def splitmix(x: np.ndarray) -> np.ndarray:
    x = np.atleast_1d(np.asarray(x, _U)) + _U(GOLDEN)
    x = (x ^ x >> _U(30)) * _U(MIX_1)
    x = (x ^ x >> _U(27)) * _U(MIX_2)
    return x ^ x >> _U(31)


def _as_bytes(x: str | bytes | None) -> bytes:
    return b"" if x is None else x.encode() if isinstance(x, str) else bytes(x)


#: Bytes of blocks that go through the arrays at once.
_RUN_BYTES = 500_000


def _runs(blocks: list[bytes]):
    """Spans of blocks of about _RUN_BYTES together; a longer block is a span of its own."""
    start, held = 0, 0
    for i, x in enumerate(blocks):
        if i > start and held + len(x) > _RUN_BYTES:
            yield start, i
            start, held = i, 0
        held += len(x)
    if start < len(blocks):
        yield start, len(blocks)


def structural_keys(blocks: list[bytes]) -> np.ndarray:
    """Of each block a hash of its length, its first bytes, and which bytes follow markers near its start: a byte of all blocks at a time."""
    n = np.array([len(x) for x in blocks], np.int64)
    near = np.zeros((len(blocks), MARKER_BYTES), np.uint8)
    for row, x in zip(near, blocks, strict=True):
        row[: min(len(x), MARKER_BYTES)] = np.frombuffer(x, np.uint8, min(len(x), MARKER_BYTES))
    h = splitmix(n.astype(_U))
    for i in range(KEY_BYTES):
        has = n > i
        h[has] = splitmix(h[has] ^ near[has, i].astype(_U) << _U(8 * (i % 8)))
    marked = (near[:, :-1] == MARKER) & (np.arange(1, MARKER_BYTES)[None, :] < n[:, None])
    bits = np.where(marked, _U(1) << (near[:, 1:] & 63).astype(_U), _U(0))
    return splitmix(h ^ np.bitwise_or.reduce(bits, axis=1))


def _majorities(z: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Of each block, whose next total[i] values are its own, the bits that most of them have, ties 0. Every eighth bit is a byte of
    its own, so that eight sums of at most 255 values are one sum of words."""
    pieces = -(-total // 255)
    first = np.cumsum(pieces) - pieces
    start = np.repeat(np.cumsum(total) - total, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(first, pieces))
    some, out = np.flatnonzero(total), np.zeros(len(total), _U)
    for k in range(8):
        sums = np.add.reduceat(z >> _U(k) & _U(0x0101010101010101), start)
        ones = np.add.reduceat(sums.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), first[some], axis=0)
        votes = 2 * ones > total[some, None]
        out[some] |= np.bitwise_or.reduce(votes.astype(_U) << (8 * np.arange(8) + k).astype(_U), axis=1)
    return out


def simhashes(blocks: list[bytes]) -> np.ndarray:
    """Of each block the majority by bit of the hashes of its byte 3-grams (of bytes, if there are fewer than three), ties 0: the votes of
    all grams of a run of blocks are summed together."""
    out = np.zeros(len(blocks), _U)
    for a, b in _runs(blocks):
        parts = [x[PREFIX:] if len(x) > PREFIX_LEAST else x for x in blocks[a:b]]
        data, n = np.frombuffer(b"".join(parts), np.uint8).astype(_U), np.array([len(x) for x in parts])
        if not len(data):
            continue
        row, left = np.repeat(np.arange(b - a), n), np.concatenate([np.arange(k, 0, -1) for k in n])
        three = n[row] > 2
        value = data.copy()
        at = np.flatnonzero(three & (left > 2))
        value[at] = (data[at] << _U(16) | data[at + 1] << _U(8) | data[at + 2]) * _U(GOLDEN)
        keep = np.flatnonzero(~three | (left > 2))
        z, total = splitmix(value[keep]), np.where(n > 2, n - 2, n)
        out[a:b] = _majorities(z, total)
    return out


@F.pandas_udf(T.StringType())
def structural_key_hex(block: pd.Series) -> pd.Series:
    return pd.Series([f"{x:016x}" for x in structural_keys([_as_bytes(x) for x in block]).tolist()])


@F.pandas_udf(T.StringType())
def simhash_hex(block: pd.Series) -> pd.Series:
    return pd.Series([f"{x:016x}" for x in simhashes([_as_bytes(x) for x in block]).tolist()])


def following_bits(text: Column, marker: int, near: int) -> Column:
    """Bits 0 to 61 for the lowest six bits of the bytes that follow a marker byte among the first bytes of a text."""
    digits = F.hex(F.substring(F.encode(text, "UTF-8"), 1, near))

    def fold(h: Column) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor(F.char_length(h) / 2).cast("int") - 2))
        low = F.transform(F.filter(at, lambda i: F.substring(h, 2 * i + 1, F.lit(2)) == f"{marker:02X}"), lambda i: F.conv(F.substring(h, 2 * i + 3, F.lit(2)), 16, 10).cast("int").bitwiseAND(63))
        # A power of two, as Spark's shift takes no column for its distance.
        return F.aggregate(F.filter(low, lambda b: b < 62), F.lit(0).cast("long"), lambda s, b: s.bitwiseOR(F.pow(F.lit(2.0), b).cast("long")))

    return let(digits, fold)
