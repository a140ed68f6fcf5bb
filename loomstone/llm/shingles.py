"""Distinct word shingles of documents as sorted 64-bit hashes."""

from __future__ import annotations

import numpy as np

from loomstone.llm.hashing import U, blocks, mix, span_hashes

WORDS = 5
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLOCK_BYTES = 500_000


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of the words of rows stored back to back; no word crosses a row's end."""
    inside = ~_SPACE[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    starts[cut] = inside[cut]
    ends[cut - 1] = inside[cut - 1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(offsets, s, side="right") - 1


def shingle_rows(data: np.ndarray, offsets: np.ndarray):
    """Yields (row, sorted distinct shingle hashes) for each row, in order.

    Words are runs outside space and 0x09-0x0D, A-Z lower-cased. A row with fewer than five
    words, but at least one, has its whole sequence as its only shingle; without words, none.
    """
    for a, b in blocks(np.diff(offsets), _BLOCK_BYTES):
        part, at = _LOWER[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a]
        s, e, row = word_spans(part, at)
        words = span_hashes(part, s, e)
        first = np.searchsorted(row, np.arange(b - a + 1))
        n = len(words)
        grams = np.zeros(max(0, n - WORDS + 1), U)
        for k in range(WORDS):
            grams += mix(words[k : n - WORDS + 1 + k] + U(k)) if len(grams) else U(0)
        grams = mix(grams)
        for i in range(b - a):
            lo, hi = first[i], first[i + 1]
            if hi - lo >= WORDS:
                yield a + i, np.unique(grams[lo : hi - WORDS + 1])
            elif hi > lo:
                short = U(hi - lo)
                for k in range(lo, hi):
                    short = mix(np.array([short]) + mix(words[k : k + 1] + U(k - lo)))[0]
                yield a + i, np.array([short], U)
            else:
                yield a + i, np.zeros(0, U)
