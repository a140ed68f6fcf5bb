"""Vectorised 64-bit hashing of words, n-grams and sets with numpy (used inside Arrow batches)."""

from __future__ import annotations

import numpy as np

from loomstone.functions.hashing import splitmix as mix

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_BASE_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
_powers = {"up": np.ones(1, U), "down": np.ones(1, U)}


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) <= n:
        size = max(n + 1, 1 << 16)
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            steps = np.full(size, base, U)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=U)
    return _powers["up"], _powers["down"]


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of codes[starts[i]:ends[i]] for each i; equal content gives equal hashes anywhere.

    Prefix sums of a polynomial modulo 2**64, shifted back to the span's start, then mixed
    with the span's length.
    """
    up, down = _powers_to(len(codes))
    total = np.zeros(len(codes) + 1, U)
    np.cumsum((codes.astype(U) + U(1)) * up[: len(codes)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + U(31) * (ends - starts).astype(U))


def blocks(lengths: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Row ranges whose lengths sum to `most` at most; a longer row gets a range of its own."""
    out, start, held = [], 0, 0
    for i, n in enumerate(lengths):
        if i > start and held + n > most:
            out.append((start, i))
            start, held = i, 0
        held += int(n)
    if start < len(lengths):
        out.append((start, len(lengths)))
    return out


def utf8_column(column) -> tuple[np.ndarray, np.ndarray]:
    """Arrow string column (nulls: empty) as UTF-8 bytes and n + 1 offsets, without a copy if possible."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if column.null_count:
        column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]
