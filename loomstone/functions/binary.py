"""Integers and bits as bytes, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomstone.functions.scalar import let


def byte_at(content: Column, at: Column | int) -> Column:
    """The byte at an offset counted from 1, as a long; null past the end."""
    digits = F.hex(F.substring(content, F.lit(at) if isinstance(at, int) else at, F.lit(1)))
    return F.when(digits != "", F.conv(digits, 16, 10).cast("long"))


def from_le(content: Column, at: Column | int, size: int) -> Column:
    """The little-endian integer of `size` bytes at an offset counted from 1 (below 2**63)."""
    digits = F.hex(F.substring(content, F.lit(at) if isinstance(at, int) else at, F.lit(size)))
    turned = lambda h: F.concat(*[F.substring(h, 2 * (size - k) - 1, 2) for k in range(size)])
    return let(digits, lambda h: F.when(F.char_length(h) == 2 * size, F.conv(turned(h), 16, 10).cast("long")))


def to_le(value: Column, size: int) -> Column:
    """A non-negative integer as `size` little-endian bytes."""
    digits = F.lpad(F.hex(value), 2 * size, "0")
    return let(digits, lambda h: F.unhex(F.concat(*[F.substring(h, 2 * (size - k) - 1, 2) for k in range(size)])))


def from_uvarint(content: Column) -> Column:
    """The integer whose groups of 7 bits, lowest first, are these bytes; more than nine of them are an error."""
    groups = [F.coalesce(F.shiftleft(byte_at(content, k + 1).bitwiseAND(127), 7 * k), F.lit(0)) for k in range(9)]
    return F.when(F.octet_length(content) <= 9, reduce(lambda a, b: a + b, groups)).otherwise(F.raise_error(F.lit("a varint has more than nine bytes")).cast("long"))


def pack_bits(bits: Column) -> Column:
    """A string of 0 and 1 as bytes, highest bit first, padded with zeros."""
    n = F.ceil(F.char_length(bits) / 8).cast("int")
    full = F.rpad(bits, n * 8, F.lit("0"))
    digits = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.lpad(F.conv(F.substring(full, k * 8 + 1, F.lit(8)), 2, 16), 2, "0"))
    return F.when(F.char_length(bits) > 0, F.unhex(F.array_join(digits, ""))).otherwise(F.lit(b""))


def unpack_bits(content: Column, count: Column) -> Column:
    """The first `count` bits of pack_bits()."""
    n = F.octet_length(content)
    digits = F.transform(F.sequence(F.lit(1), n), lambda k: F.lpad(F.conv(F.hex(F.substring(content, k, F.lit(1))), 16, 2), 8, "0"))
    return F.substring(F.when(n > 0, F.array_join(digits, "")).otherwise(""), F.lit(1), count)
