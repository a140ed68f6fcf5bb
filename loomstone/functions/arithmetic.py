"""A range coder over cumulative integer masses, for segments that are coded one by one.

Every doubling of the range gives a digit: 0 for the lower half, 2 for the upper, 1 for the middle. These are digits of
twice the output to base 2, so that a carry needs no special case until they are added up at the end.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

#: The coder's precision.
BITS = 32
HALF, QUARTER = 1 << BITS - 1, 1 << BITS - 2
#: (index, symbols so far) -> cumulative masses, one more than there are symbols.
Predictor = Callable[[int, Sequence[int]], Sequence[int]]


def masses(chances: Sequence[float]) -> list[int]:
    """Cumulative integer masses of chances: millionths, rounded, at least 1 each."""
    out = [0]
    for p in chances:
        out.append(out[-1] + max(1, int(p * 1_000_000 + 0.5)))
    return out


def _narrow(low: int, high: int, cum: Sequence[int], symbol: int) -> tuple[int, int]:
    width = high - low + 1
    return low + width * cum[symbol] // cum[-1], low + width * cum[symbol + 1] // cum[-1] - 1


def _shift(low: int, high: int) -> int | None:
    """What to take off before doubling, or None if the range is wide enough."""
    if high < HALF:
        return 0
    if low >= HALF:
        return HALF
    return QUARTER if low >= QUARTER and high < HALF + QUARTER else None


def encode(symbols: Sequence[int], predictor: Predictor) -> bytes:
    low, high, digits = 0, 2 * HALF - 1, bytearray()
    past = memoryview(symbols) if isinstance(symbols, bytes) else symbols  # a slice of which is no copy
    for i, symbol in enumerate(symbols):
        low, high = _narrow(low, high, predictor(i, past[:i]), symbol)
        while (off := _shift(low, high)) is not None:
            low, high = 2 * (low - off), 2 * (high - off) + 1
            digits.append(off // QUARTER)
    digits += bytes([1, 0 if low < QUARTER else 2])
    return summed(np.frombuffer(digits, np.uint8))


def summed(d: np.ndarray) -> bytes:
    """The bytes of the number that digits add up to."""
    odd, even = (int.from_bytes(np.packbits(x).tobytes(), "big") for x in (d & 1, d >> 1))
    return (odd + 2 * even >> 1).to_bytes(-(-len(d) // 8), "big")


def decode(payload: bytes, count: int, predictor: Predictor) -> list[int]:
    from bisect import bisect_right

    bits = np.unpackbits(np.frombuffer(payload, np.uint8)).tobytes() + bytes(BITS)
    low, high, out, at = 0, 2 * HALF - 1, [], BITS
    code = int.from_bytes(np.packbits(np.frombuffer(bits[:BITS], np.uint8)).tobytes(), "big")
    for i in range(count):
        cum = predictor(i, out)
        offset = ((code - low + 1) * cum[-1] - 1) // (high - low + 1)
        symbol = bisect_right(cum, offset) - 1
        out.append(symbol)
        low, high = _narrow(low, high, cum, symbol)
        while (off := _shift(low, high)) is not None:
            low, high, code = 2 * (low - off), 2 * (high - off) + 1, 2 * (code - off) + (bits[at] if at < len(bits) else 0)
            at += 1
    return out
