"""Hashed word and character n-gram features of texts, computed on whole batches with numpy."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

from loomstone.llm.hashing import U, blocks, mix, span_hashes

_BLOCK_CHARS = 250_000
_SPACE = 32


def _separators(letters_only: bool) -> np.ndarray:
    """For each code point below 0x3100, whether it separates words: white space or, if asked, all but letters."""
    return np.array([chr(i).isspace() or letters_only and not chr(i).isalpha() for i in range(0x3100)])


_TABLES = {kind: _separators(kind) for kind in (False, True)}


def hashed_features(texts: Sequence[str], bits: int, grams: Sequence[int], letters_only: bool, word_grams: Sequence[int] = (), patterns: Sequence[int] = (), prefixes: Sequence[int] = ()) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yields (first row, end row, row of each feature from 0, bucket of each feature) for runs of rows.

    Words are runs between separators: white space or, with letters_only, anything but letters,
    of the lower-cased text. Features are whole words and character n-grams that no
    separator cuts; one may stand at either end of a gram, to mark a word's end. Prefixes are
    the beginnings, of these lengths, of longer words. Word grams are runs of so many words of a text, in order;
    patterns are word grams in which each word stands for its first place in the gram: all that is told is which words are equal.
    """
    table = _TABLES[letters_only]
    for a, b in blocks([len(x) for x in texts], _BLOCK_CHARS):
        part = [x.lower() for x in texts[a:b]] if letters_only else texts[a:b]
        codes = np.frombuffer(("\n" + "\n".join(part) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        cut = np.where(codes < len(table), table[np.minimum(codes, len(table) - 1)], False)
        codes = np.where(cut, np.uint32(_SPACE), codes)
        row = np.repeat(np.arange(b - a), [len(x) + 1 for x in part])  # of each code point after the first
        found = []
        wide = codes.astype(U)
        for n in grams:
            m = len(codes) - n + 1
            if m <= 0:
                continue
            bad = np.zeros(m, bool)
            for k in range(1, n - 1):
                bad |= cut[k : k + m]
            total = np.zeros(m, U)
            for k in range(n):
                total += wide[k : k + m]
                total *= U(0x9E3779B97F4A7C15 + 2 * n)
            at = np.flatnonzero(~bad)
            h = total[at]
            h ^= h >> U(31)
            h *= U(0xBF58476D1CE4E5B9)
            found.append((at + 1, h >> U(64 - bits)))
        inside = ~cut
        starts = np.flatnonzero(inside[1:] & cut[:-1]) + 1
        ends = np.flatnonzero(cut[1:] & inside[:-1]) + 1
        words = span_hashes(codes, starts, ends)
        found.append((starts, words >> U(64 - bits)))
        for n in prefixes:
            longer = starts[ends - starts > n]
            found.append((longer, span_hashes(codes, longer, longer + n) * U(0x9E3779B97F4A7C15 + 2 * n) >> U(64 - bits)))
        for n in sorted({*word_grams, *patterns}):
            first = np.flatnonzero(row[starts[n - 1 :] - 1] == row[starts[: len(starts) - n + 1] - 1])
            total, places = np.zeros(len(first), U), np.full(len(first), n, U)
            for k in range(n):
                total = mix(total + words[first + k])
                place = np.full(len(first), k, U)
                for j in range(k - 1, -1, -1):
                    place[words[first + j] == words[first + k]] = j
                places = places * U(n + 1) + place
            found += [(starts[first], h >> U(64 - bits)) for h, asked in ((total, word_grams), (mix(places), patterns)) if n in asked]
        yield a, b, np.concatenate([row[at - 1] for at, _ in found]), np.concatenate([h for _, h in found]).astype(np.int64)
