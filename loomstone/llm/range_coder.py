"""An adaptive context-mixing range coder for token ids, run in step over many blocks at once.

Every block is coded on its own from a fresh state, so that it can be decoded without any other and
numpy can take the k-th id of all blocks in one step. A block begins with its different ids in the order in which they appear, in
16 bits each (32, if one is longer), and numbers them so. An id is first compared with what the order-2 and
order-1 contexts of its block predict; the chances of the three outcomes (order 2, order 1, neither) adapt by
the two contexts' confidences and by the last outcome together. If neither predicts it, it is coded by the block's order-0 counts, in which an id
that the block hasn't had yet stands as one more symbol. Order-0 counts are put in order again whenever the block has grown
by a quarter; until then a new id counts once. Arithmetic is on whole numbers, in doubles
only below 2**53, so that decoding repeats encoding exactly on any machine. Ids are 0 to 2**31 - 1.
"""

from __future__ import annotations

import zlib

import numpy as np

BLOCK = 1024
#: Blocks coded in step at most: few enough for their state to stay near the processor, many enough for a step's calls.
LANES = 3000
#: Bits of mixed chances, and by which part of itself a block grows until its counts are put in order.
_MIX, _GROWTH = 14, 4
#: Places for what followed two ids, by a hash of them.
_PAIRS = 256
#: A coder's full range, its least one, and a word of output. Totals stay below 2**25, so that a step moves two words at most.
_FULL, _LEAST, _WORD = 2.0**48, 2.0**32, 2.0**16


def _first() -> np.ndarray:
    """Chances to begin with, by the confidence of order 2 and of order 1 (0: nothing predicted), whether they agree, and the last outcome."""
    c2, c1, agree, _ = np.unravel_index(np.arange(128), (4, 4, 2, 4))
    p0, p1 = np.array([0, 20000, 30000, 40000])[c2], np.array([0, 9000, 14000, 20000])[c1] * (agree == 0)
    return (p0 | p1 << 16).astype(np.uint32)


_FIRST = _first()


class Coder:
    """Range coders in step, one for each lane, on whole numbers in doubles. Carries wait in the words written."""

    def __init__(self, lanes: int, data: list[np.ndarray] | None = None):
        self.range, self.every = np.full(lanes, _FULL), np.arange(lanes)
        self.reads = data is not None
        if self.reads:
            sizes = np.array([len(x) for x in data], np.int64)
            self.at = np.cumsum(sizes) - sizes
            self.data = np.concatenate([*data, np.zeros(4, "<u2")])
            self.code = np.zeros(lanes)
            for _ in range(3):
                self._read(self.every)
        else:
            self.low, self.at, self.data = np.zeros(lanes), self.every.copy(), np.zeros((2 * BLOCK + 3) * lanes, np.uint32)

    def _read(self, lane: np.ndarray) -> None:
        at = self.at[lane]
        self.code[lane] = self.code[lane] * _WORD + self.data[np.minimum(at, len(self.data) - 1)]
        at += 1
        self.at[lane] = at

    def _write(self, lane: np.ndarray) -> None:
        low, at = self.low[lane], self.at[lane]
        word = np.floor(low * (1 / _LEAST))
        self.data[at] = word
        self.low[lane] = (low - word * _LEAST) * _WORD
        at += len(self.low)
        self.at[lane] = at

    def target(self, unit: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Reading: where in 0 .. total - 1 the lanes' code lies, where one of total is unit of a range."""
        return np.minimum(np.floor(self.code / unit), total - 1)

    def step(self, unit: np.ndarray, low: np.ndarray, size: np.ndarray) -> None:
        """Narrows the lanes' ranges to [low, low + size), in units, and moves words that are settled."""
        own = unit * size
        low *= unit
        if self.reads:
            self.code -= low
            np.minimum(self.code, own - 1, out=self.code)  # more than that only in a damaged block
        else:
            self.low += low
        self.range = own
        m = np.flatnonzero(own < _LEAST)
        while len(m):
            if self.reads:
                self._read(m)
            else:
                self._write(m)
            moved = own[m] * _WORD
            own[m] = moved
            m = m[moved < _LEAST]

    def words(self) -> list[np.ndarray]:
        """What each lane has written."""
        for _ in range(3):
            self._write(self.every)
        sizes = (self.at - self.every) // len(self.every)
        data = self.data[: sizes.max() * len(sizes)].reshape(-1, len(sizes))
        for k in range(len(data) - 1, 0, -1):
            data[k - 1] += data[k] >> 16
        return [row[:n] for row, n in zip(np.ascontiguousarray(data.astype("<u2").T), sizes.tolist(), strict=True)]


class Order0:
    """How often each of a block's ids came here: where its units begin among those of all, and their number, as place = begin | number << 16."""

    def __init__(self, lanes: int, steps: int, reads: bool):
        self.row, self.seen, self.due = np.arange(lanes) * BLOCK, np.zeros(lanes, np.int64), 8
        self.count, self.place = np.zeros((lanes, BLOCK), np.int16), np.zeros((lanes, BLOCK), np.int32)
        # Whose each unit is: those in order, of each lane, and then the ids of each step as they were read, for units that aren't in order yet.
        self.units = np.zeros((BLOCK + steps) * lanes, np.int16) if reads else None
        self.past = self.units[BLOCK * lanes :].reshape(steps, lanes) if reads else None

    def order(self, k: int, past: np.ndarray) -> None:
        """Puts the units of the first k ids, the last of which are past, in their ids' order."""
        np.add.at(self.count.reshape(-1), (self.row + past).ravel(), np.int16(1))
        n = int(self.seen.max())
        count = self.count[:, :n].astype(np.int32)
        if self.units is not None:
            self.units[: BLOCK * len(count)].reshape(-1, BLOCK)[:, :k] = np.repeat(np.tile(np.arange(n, dtype=np.int16), len(count)), count.ravel()).reshape(-1, k)
        begin = np.cumsum(count, axis=1, dtype=np.int32)
        begin -= count
        count <<= 16
        count |= begin
        self.place[:, :n] = count
        self.due = k + max(8, k // _GROWTH)


def _slots(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each id of each row the number of different ids that the row had before it first appeared, and whether it first appears here."""
    lanes, steps = table.shape
    key = table.astype(np.int64 if table.max() >> 21 else np.int32)
    key <<= 10
    key |= np.arange(steps, dtype=key.dtype)
    key.sort(axis=1)
    step = (key & BLOCK - 1) + (np.arange(lanes) * steps)[:, None]
    key >>= 10
    starts = np.ones((lanes, steps), bool)
    np.not_equal(key[:, 1:], key[:, :-1], out=starts[:, 1:])
    step, starts = step.ravel(), np.flatnonzero(starts)
    first = np.zeros(lanes * steps, np.int16)
    first[step[starts]] = 1
    rank = np.cumsum(first.reshape(lanes, steps), axis=1, dtype=np.int16).ravel() - np.int16(1)
    out = np.empty(lanes * steps, np.int16)
    out[step] = np.repeat(rank[step[starts]], np.diff(np.append(starts, len(step))))
    return out.reshape(lanes, steps), first.reshape(lanes, steps) > 0


def _run(lanes: int, steps: int, coder: Coder, slots: np.ndarray | None) -> np.ndarray:
    """slots: (steps, lanes) of ids' numbers in their blocks to encode, or None to read them; returns them."""
    reads = slots is None
    every, order0, done = np.arange(lanes), Order0(lanes, steps, reads), 0
    past = order0.past if reads else slots
    place, units, row, seen = order0.place.reshape(-1), order0.units, order0.row, order0.seen
    # What followed a context, of order 2 and of order 1, as its slot plus 1, and above 12 bits how often in a row.
    guess, base = np.zeros(lanes * (BLOCK + _PAIRS), np.int16), np.array([every * _PAIRS + lanes * BLOCK, row])
    # By both contexts' confidences and the last outcome the chances of order 2 and, above its 16 bits, of order 1, in 2**-16.
    chance, context = np.tile(_FIRST, lanes), every * len(_FIRST)
    one, two, last = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64), np.full(lanes, 2, np.int16)
    at = np.empty_like(base)
    for k in range(steps):
        if k == order0.due:
            order0.order(k, past[done:k])
            done = k
        np.bitwise_and(one * 40503 + two * 30011 >> 3, _PAIRS - 1, out=at[0])
        np.bitwise_and(one, BLOCK - 1, out=at[1])
        at += base
        held = guess[at]
        g, c = held & np.int16(0xFFF), held >> np.int16(12)
        near = context + (((c[0] << 2 | c[1]) << 1 | (g[0] == g[1])) << 2 | last)
        both = chance[near]
        p0, p1 = both & 0xFFFF, both >> 16
        h0, h1 = p0 >> 16 - _MIX, p1 >> 16 - _MIX
        rest = ((1 << _MIX) - h0 - h1).astype(np.float64)
        fresh = (seen >> 1) + 1.0
        all0 = fresh + k
        total = all0 * (1 << _MIX)
        low1 = h0 * all0
        low2 = total - rest * all0
        unit = np.floor(coder.range / total)
        if reads:
            target = coder.target(unit, total)
            inner = np.floor((target - low2) / rest)
            new, hits = np.flatnonzero(inner >= k), np.flatnonzero(target < low2)
            inner[new] = 0
            unit_at = np.maximum(inner, 0, out=inner).astype(np.int64)
            own = np.flatnonzero(unit_at >= done)
            late = unit_at[own] * lanes + (own + lanes * BLOCK)
            unit_at += row
            unit_at[own] = late
            slot = units[unit_at]
            slot[new] = seen[new]
            is0 = target[hits] < low1[hits]
            slot[hits] = np.where(is0, g[0, hits], g[1, hits]) - np.int16(1)
            past[k] = slot
            x = slot + np.int16(1)
            again = g == x
        else:
            slot = past[k]
            x = slot + np.int16(1)
            again = g == x
            new, hits = np.flatnonzero(slot == seen), np.flatnonzero(again[0] | again[1])
            is0 = again[0, hits]
        hit0, hit1 = hits[is0], hits[~is0]
        spot = row + slot
        number = place[spot]
        begin = number & 0xFFFF
        number >>= 16
        begin[new] = k
        number = number.astype(np.float64)
        number[new] = fresh[new]
        low, size = low2 + rest * begin, rest * number
        low[hit0], size[hit0] = 0, low1[hit0]
        low[hit1], size[hit1] = low1[hit1], low2[hit1] - low1[hit1]
        coder.step(unit, low, size)
        place[spot[new]] = k | 1 << 16
        seen[new] += 1
        p0 -= p0 >> 5
        p1 -= p1 >> 5
        p0[hit0] += 2000
        p1[hit1] += 2000
        p1 <<= 16
        p1 |= p0
        chance[near] = p1
        again &= c < 3
        held = (again * c + np.int16(1)) << np.int16(12)
        guess[at] = held | x
        last.fill(2)
        last[hit0], last[hit1] = 0, 1
        one, two = x.astype(np.int64), one
    return past


def _groups(lanes: int) -> list[slice]:
    """Lanes in groups of much the same size, LANES at most."""
    n = -(-lanes // LANES)
    return [slice(lanes * k // n, lanes * (k + 1) // n) for k in range(n)]


def encode(ids: np.ndarray) -> tuple[list[bytes], list[int]]:
    """Payload and crc32 (of its ids as little-endian 32-bit integers) of each block of BLOCK ids.

    The last block may be shorter: it is coded as if its last id was repeated. No ids: no blocks."""
    if not len(ids):
        return [], []
    if ids.min() < 0 or ids.max() >= 1 << 31:
        raise ValueError("ids must lie in 0 .. 2**31 - 1")
    lanes, steps = -(-len(ids) // BLOCK), min(len(ids), BLOCK)
    table = np.full(lanes * steps, ids[-1], np.int32)
    table[: len(ids)] = ids
    table, payloads = table.reshape(lanes, steps), []
    for group in _groups(lanes):
        own = table[group]
        slots, first = _slots(own)
        coder = Coder(len(own))
        _run(len(own), steps, coder, np.ascontiguousarray(slots.T))
        names, counts = own[first], first.sum(axis=1)
        wide = np.where(first, own, 0).max(axis=1) > 0xFFFF
        for words, n, end, w in zip(coder.words(), counts.tolist(), np.cumsum(counts).tolist(), wide.tolist(), strict=True):
            payloads.append((n | w << 15).to_bytes(2, "little") + names[end - n : end].astype("<u4" if w else "<u2").tobytes() + words.tobytes())
    raw = memoryview(table.astype("<u4", copy=False)).cast("B")
    return payloads, [zlib.crc32(raw[4 * steps * k : 4 * min(len(ids), (k + 1) * steps)]) for k in range(lanes)]


def decode(sizes: list[int], payloads: list[bytes], checksums: list[int]) -> np.ndarray:
    """The ids of any blocks of encode(), one after the other; sizes has the number of ids of each.

    A block whose ids don't have its checksum raises ValueError; others don't depend on it."""
    if not len(sizes) == len(payloads) == len(checksums):
        raise ValueError(f"{len(sizes)} sizes, {len(payloads)} blocks, {len(checksums)} checksums")
    if not len(sizes):
        return np.zeros(0, np.int32)
    out = []
    for group in _groups(len(sizes)):
        own = sizes[group]
        names, words = np.zeros((len(own), BLOCK), np.int32), []
        for k, p in enumerate(payloads[group]):
            data = np.frombuffer(p, "<u2", len(p) // 2)
            n, wide = (min(int(data[0]) & 0x7FFF, BLOCK), data[0] >> 15) if len(data) else (0, 0)
            own_names = data[1 : 1 + 2 * n][: (len(data) - 1) // 2 * 2].view("<u4") if wide else data[1 : 1 + n]
            names[k, : len(own_names)] = own_names.astype(np.int32)
            words.append(data[1 + (2 * n if wide else n) :])
        slots = _run(len(own), max(own), Coder(len(own), words), None)
        found = np.empty((len(own), len(slots)), np.int32)
        for k in range(0, len(own), 256):  # so that the names stay near
            found[k : k + 256] = np.take_along_axis(names[k : k + 256], np.ascontiguousarray(slots[:, k : k + 256].T).astype(np.int64), axis=1)
        out += [row[:n] for row, n in zip(found, own, strict=True)]
    for k, row in enumerate(out):
        if zlib.crc32(row.astype("<u4", copy=False)) != checksums[k]:
            raise ValueError(f"block {k} is damaged")
    return np.concatenate(out)


def sizes_of(n: int) -> list[int]:
    """The sizes of the blocks that n ids make."""
    return [min(BLOCK, n - at) for at in range(0, n, BLOCK)]
