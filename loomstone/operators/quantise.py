"""Low-bit quantisation of vectors as array expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomstone.functions.scalar import let

#: Magnitudes of the 4-bit float with 2 exponent bits and 1 mantissa bit, by code.
FP4_MAGNITUDES = (0.0, 0.5, 1.0, 1.5, 2.0, 3.0, 4.0, 6.0)


def largest(x: Column) -> Column:
    return F.array_max(F.transform(x, F.abs))


def _scaled(x: Column, one: Callable[[Column, Column], Column]) -> Column:
    """x with one(component, largest magnitude) for each component; a zero vector stays. The magnitude
    is found once and not for each component."""
    return let(largest(x), lambda top: F.when(top == 0, x).otherwise(F.transform(x, lambda v: one(v, top))))


def symmetric(x: Column, bits: int) -> Column:
    """Each component at the nearest of 2**bits levels spread evenly over [-max, max]; a zero vector stays."""
    k = (1 << bits) - 1
    return _scaled(x, lambda v, top: F.floor((v + top) / (2 * top) * k + 0.5) * 2 * top / k - top)


def fp4(x: Column) -> Column:
    """Each component at the nearest signed magnitude, scaled so that the largest component is exact; ties go up."""

    def one(v: Column, top: Column) -> Column:
        a = F.abs(v) * FP4_MAGNITUDES[-1] / top
        near = F.lit(FP4_MAGNITUDES[-1])
        for low, high in reversed(list(zip(FP4_MAGNITUDES, FP4_MAGNITUDES[1:], strict=False))):
            near = F.when(a < (low + high) / 2, F.lit(low)).otherwise(near)
        return F.signum(v) * top / FP4_MAGNITUDES[-1] * near

    return _scaled(x, one)


def rms_error(x: Column, y: Column) -> Column:
    d = F.zip_with(x, y, lambda a, b: (a - b) * (a - b))
    return F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, v: s + v) / F.size(x))


def unpack(packed: Column, bits: int, count: Column) -> Column:
    """The first `count` codes of `bits` bits each, lowest bits of the first byte first (bits up to 8)."""
    byte = lambda k: F.conv(F.hex(F.substring(packed, k + 1, F.lit(1))), 16, 10).cast("int")

    def one(i: Column) -> Column:
        start = (i * bits / 8).cast("int")
        word = F.coalesce(byte(start), F.lit(0)) + 256 * F.coalesce(byte(start + 1), F.lit(0))
        return F.pmod(F.floor(word / F.pow(F.lit(2), F.pmod(i * bits, F.lit(8)))).cast("int"), F.lit(1 << bits))

    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), one)).otherwise(F.array().cast("array<int>"))


def dequantised(codes: Column, bits: Column, mode: Column, codebook: Column, scale: Column) -> Column:
    """Numbers of codes of `bits` bits (0, 2, 3 or 4) by a mode: lloyd takes the channel's codebook, shared a common one times the
    scale, symmetric evenly spaced levels, fp4 (and, at 4 bits, hybrid_fp4_symmetric) the 4-bit float; no bits give zeros."""
    center = (F.pow(F.lit(2.0), bits) - 1) / 2
    table = F.array(*[F.lit(sign * m) for sign in (1.0, -1.0) for m in FP4_MAGNITUDES])
    as_float = (mode == "fp4") | ((mode == "hybrid_fp4_symmetric") & (bits == 4))
    value = F.when(bits == 0, F.transform(codes, lambda _: F.lit(0.0))).when(mode == "lloyd", F.transform(codes, lambda k: F.get(codebook, k)))
    value = value.when(as_float, F.transform(codes, lambda k: F.get(table, k) * scale)).when(mode == "shared", F.transform(codes, lambda k: F.get(codebook, k) * scale))
    known = mode.isin("symmetric", "hybrid_fp4_symmetric")
    value = value.when(known, F.transform(codes, lambda k: (k - center) * scale))
    return value.otherwise(F.raise_error(F.concat(F.lit("no such mode: "), mode)).cast("array<double>"))
