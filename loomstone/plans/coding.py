"""Range-coded segments and trailers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.functions import arithmetic
from loomstone.operators.ordered import chunk_starts
from loomstone.plans.registry import query
from loomstone.sources.tables import append_trailer, split_trailer, table


SEGMENT = 512


@query("SELECT conv_id, turn, start, CAST(least(512, strlen(text) - start) AS INTEGER) AS bytes, true AS small, true AS ok FROM (SELECT conv_id, turn, text, unnest(range(0, strlen(text), 512)) AS start FROM conversations)")
def q_range_coder(spark: SparkSession, folder: str) -> DataFrame:
    """Every text of conversations in segments of 512 bytes, coded by the counts of the segment's own past: whether the payload
    has at most a byte more than the segment and its first symbols ask for, and whether decoding (which predicts anew from what it has decoded) gives the bytes back."""
    raw = F.encode("text", "UTF-8")
    start = F.explode(chunk_starts(F.octet_length("text").cast("long"), SEGMENT))
    segments = table(spark, folder, "conversations").select("conv_id", "turn", raw.alias("raw"), start.alias("start"))
    segments = segments.select("conv_id", "turn", "start", F.substring("raw", (F.col("start") + 1).cast("int"), F.lit(SEGMENT)).alias("segment"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            coded = encode_by_counts(list(pdf["segment"]))
            same = [found == x for found, x in zip(decode_by_counts(coded, [len(x) for x in pdf["segment"]]), pdf["segment"], strict=True)]
            yield pdf.drop(columns="segment").assign(bytes=pdf["segment"].map(len), small=[len(c) <= len(x) + 2 for c, x in zip(coded, pdf["segment"], strict=True)], ok=same)

    return segments.mapInPandas(run, "conv_id long, turn long, start long, bytes int, small boolean, ok boolean")


class AdaptiveCounts:
    """A predictor of bytes: one plus how often each came before, as cumulative masses."""

    def __init__(self) -> None:
        self.masses, self.seen = list(range(257)), 0

    def __call__(self, i: int, before) -> list[int]:
        for symbol in before[self.seen : i]:
            self.masses[symbol + 1 :] = [m + 1 for m in self.masses[symbol + 1 :]]
        self.seen = i
        return self.masses


#: Bytes that are coded in step, and segments below which each is coded by itself.
_STEP_BYTES, _FEW = 300_000, 8


def _in_step(lengths: Sequence[int]) -> Iterator[np.ndarray]:
    """Places of segments in runs of about _STEP_BYTES together, longest first."""
    order = np.argsort(-np.asarray(lengths, np.int64), kind="stable")
    run = np.cumsum(np.asarray(lengths, np.int64)[order]) // _STEP_BYTES
    yield from np.split(order, np.flatnonzero(np.diff(run)) + 1) if len(order) else []


def encode_by_counts(segments: list[bytes]) -> list[bytes]:
    """arithmetic.encode of each segment with AdaptiveCounts of its own, the k-th byte of a run's segments in one step."""
    out: list[bytes] = [b""] * len(segments)
    for run in _in_step([len(x) for x in segments]):
        own = [bytes(segments[i]) for i in run]
        coded = [arithmetic.encode(x, AdaptiveCounts()) for x in own] if len(own) < _FEW else _Lanes([len(x) for x in own]).encode(own)
        for i, x in zip(run, coded, strict=True):
            out[i] = x
    return out


def decode_by_counts(payloads: list[bytes], lengths: list[int]) -> list[bytes]:
    """The segments of encode_by_counts, of these lengths; counts are of what has been decoded."""
    out: list[bytes] = [b""] * len(payloads)
    for run in _in_step(lengths):
        own, n = [bytes(payloads[i]) for i in run], [lengths[i] for i in run]
        found = [bytes(arithmetic.decode(x, k, AdaptiveCounts())) for x, k in zip(own, n, strict=True)] if len(own) < _FEW else _Lanes(n).decode(own)
        for i, x in zip(run, found, strict=True):
            out[i] = x
    return out


class _Lanes:
    """Range coders side by side, longest first. Counts are kept as running sums in 16 groups of 16 bytes, and all doublings of a
    range between two bytes are done at once: first those that settle a digit, then those in the middle."""

    def __init__(self, lengths: list[int]) -> None:
        n = len(lengths)
        self.n = np.array(lengths, np.int64)
        self.groups = np.tile(np.arange(0, 257, 16), (n, 1))
        self.inner = np.tile(np.arange(17), (n, 16, 1))
        self.low, self.high = np.zeros(n, np.int64), np.full(n, 2 * arithmetic.HALF - 1, np.int64)

    def _active(self) -> Iterator[tuple[int, np.ndarray]]:
        """(step, lanes that have a byte in it)."""
        lanes, at = np.arange(len(self.n)), np.searchsorted(-self.n, -np.arange(self.n.max(initial=0)), "left")
        for i, k in enumerate(at.tolist()):
            yield i, lanes[:k]

    def _narrow(self, i: int, lanes: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Takes up a byte in each lane: (doublings that settle a digit, these digits as bits, doublings in the middle)."""
        k, group, within = len(lanes), symbol >> 4, symbol & 15
        start, rows = self.groups[lanes, group], self.inner[lanes, group]
        low, width = self.low[:k], self.high[:k] - self.low[:k] + 1
        high = low + width * (start + rows[lanes, within + 1]) // (256 + i) - 1
        low = low + width * (start + rows[lanes, within]) // (256 + i)
        self.inner[lanes, group] = rows + (np.arange(17) > within[:, None])
        self.groups[:k] += np.arange(17) > group[:, None]
        every = 2 * arithmetic.HALF - 1
        settled = arithmetic.BITS - _bit_length(low ^ high)
        digits = low >> arithmetic.BITS - settled
        low, high = low << settled & every, (high + 1 << settled) - 1 & every
        middle = arithmetic.BITS - 1 - _bit_length(~(low & ~high) & arithmetic.HALF - 1)
        self.low[:k] = (low - arithmetic.HALF << middle) + arithmetic.HALF
        self.high[:k] = (high + 1 - arithmetic.HALF << middle) + arithmetic.HALF - 1
        return settled, digits, middle

    def encode(self, segments: list[bytes]) -> list[bytes]:
        data = np.frombuffer(b"".join(segments), np.uint8)
        starts, parts = np.cumsum(self.n) - self.n, []
        for i, lanes in self._active():
            settled, digits, middle = self._narrow(i, lanes, data[starts[lanes] + i].astype(np.int64))
            parts.append((lanes, settled, digits, middle))
        lanes, none = np.arange(len(self.n)), np.zeros(len(self.n), np.int64)
        parts += [(lanes, none, none, none + 1), (lanes, none + 1, (self.low >= arithmetic.QUARTER).astype(np.int64), none)]
        lane, settled, digits, middle = (np.concatenate([p[k] for p in parts]) for k in range(4))
        order = np.argsort(lane, kind="stable")
        lane, settled, digits, middle = lane[order], settled[order], digits[order], middle[order]
        count = settled + middle
        left = np.repeat(settled + np.cumsum(count) - count, count) - np.arange(count.sum()) - 1  # below 0 in the middle
        every = np.where(left >= 0, 2 * (np.repeat(digits, count) >> np.maximum(left, 0) & 1), 1).astype(np.uint8)
        ends = np.cumsum(np.bincount(lane, count, len(self.n)).astype(np.int64))
        return [arithmetic.summed(d) for d in np.split(every, ends[:-1])]

    def decode(self, payloads: list[bytes]) -> list[bytes]:
        pad = bytes(16)  # past its end a payload has zeros
        sizes = np.array([len(x) + len(pad) for x in payloads])
        ends = np.cumsum(sizes)
        data = np.frombuffer(b"".join(x + pad for x in payloads), np.uint8).astype(np.int64)
        window = sum(np.roll(data, -j) << 8 * (4 - j) for j in range(5))  # five bytes from each on
        at, last = 8 * (ends - sizes), ends - 8

        def bits(k: int, n: np.ndarray) -> np.ndarray:
            found = window[np.minimum(at[:k] >> 3, last[:k])] >> 40 - (at[:k] & 7) - n & (1 << n) - 1
            at[:k] += n
            return found

        code = bits(len(self.n), np.full(len(self.n), arithmetic.BITS))
        starts, out = np.cumsum(self.n) - self.n, np.zeros(self.n.sum(), np.uint8)
        for i, lanes in self._active():
            k = len(lanes)
            offset = ((code[:k] - self.low[:k] + 1) * (256 + i) - 1) // (self.high[:k] - self.low[:k] + 1)
            group = (self.groups[:k, 1:] <= offset[:, None]).sum(1)
            rest = offset - self.groups[lanes, group]
            symbol = 16 * group + (self.inner[lanes, group][:, 1:] <= rest[:, None]).sum(1)
            out[starts[lanes] + i] = symbol
            settled, _, middle = self._narrow(i, lanes, symbol)
            code[:k] = (code[:k] << settled & 2 * arithmetic.HALF - 1) + bits(k, settled)
            code[:k] = (code[:k] - arithmetic.HALF << middle) + arithmetic.HALF + bits(k, middle)
        return [x.tobytes() for x in np.split(out, (starts + self.n)[:-1])]


def _bit_length(x: np.ndarray) -> np.ndarray:
    """Of numbers below 2**53."""
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


@query("SELECT doc_id, strlen(text) + strlen(lang) + 16 AS sealed, strlen(text) AS body, lang AS trailer FROM documents")
def q_trailers(spark: SparkSession, folder: str) -> DataFrame:
    """A trailer appended to each text (twice, to no effect the second time) and split off again."""
    once = append_trailer(F.encode("text", "UTF-8"), F.encode("lang", "UTF-8"), "LOOMTRLR")
    docs = table(spark, folder, "documents").select("doc_id", once.alias("c"))
    docs = docs.select("doc_id", append_trailer(F.col("c"), F.lit("again").cast("binary"), "LOOMTRLR").alias("c")).withColumn("s", split_trailer(F.col("c"), "LOOMTRLR"))
    return docs.select("doc_id", F.octet_length("c").cast("long").alias("sealed"), F.octet_length("s.body").cast("long").alias("body"), F.decode("s.trailer", "UTF-8").alias("trailer"))
