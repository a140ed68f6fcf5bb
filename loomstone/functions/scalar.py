"""Scalar functions as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is used: bound as the element of an array of one. (Expressions are
    otherwise put in place of each use, which also makes generated code grow.)"""
    return F.transform(F.array(value), use)[0]


def zigzag(d: Column) -> Column:
    """Sign and magnitude in one number: d < 0 gives 2|d| + 1, else 2d."""
    return F.when(d < 0, F.shiftleft(-d, 1) + 1).otherwise(F.shiftleft(d, 1))


def unzigzag(z: Column) -> Column:
    return F.when(z % 2 == 1, -F.shiftright(z, 1)).otherwise(F.shiftright(z, 1))


def uvarint_length(x: Column) -> Column:
    """Bytes of a non-negative integer in groups of 7 bits."""
    bits = F.char_length(F.bin(x))
    return F.floor((bits + 6) / 7).cast("long")


def uvarint(x: Column) -> Column:
    """The groups of 7 bits, lowest first, all but the last with the high bit set."""
    one = lambda k: F.shiftright(x, 7 * k).bitwiseAND(127)
    part = lambda k: F.when(uvarint_length(x) > k, F.lpad(F.hex(one(k) + F.when(uvarint_length(x) > k + 1, 128).otherwise(0)), 2, "0")).otherwise("")
    return F.unhex(F.concat(*[part(k) for k in range(9)]))


def mass(p: Column) -> Column:
    """A chance as an integer count of millionths, at least 1."""
    return F.greatest(F.lit(1), F.floor(p * 1_000_000 + 0.5)).cast("long")


def softcap(x: Column, up: float, down: float) -> Column:
    """tanh limits that differ by sign."""
    return F.when(x >= 0, up * F.tanh(x / up)).otherwise(down * F.tanh(x / down))


def half_life_rate(position: Column, first: float, half: float, floor: float, warm_up: float = 0) -> Column:
    """A rate that halves every `half` positions down to a floor; 0 during warm-up."""
    return F.when(position < warm_up, F.lit(0.0)).otherwise(F.greatest(F.lit(floor), first * F.pow(F.lit(0.5), position / half)))


def upper_median(values: Column) -> Column:
    """The element in the middle of an array, the upper one if there are two; 0 counts as 1024."""
    m = F.element_at(F.array_sort(values), (F.floor(F.size(values) / 2) + 1).cast("int"))
    return F.when(m == 0, 1024).otherwise(m)


def ipv4(text: Column) -> Column:
    """Four octets of 0 to 255 as one number, else null."""
    part = F.split(text, r"\.")
    octet = lambda k: F.element_at(part, k + 1).try_cast("int")
    good = text.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")
    return F.when(good & (F.greatest(*[octet(k) for k in range(4)]) <= 255), sum(octet(k).cast("long") * 256 ** (3 - k) for k in range(4)))
