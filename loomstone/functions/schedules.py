"""Rates and numbers of steps by position, and pulls toward an anchor, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed_schedule(spec: Column) -> Column:
    """Entries "pos:steps", separated by commas, as sorted structs; an empty entry is skipped, any other that isn't two positive
    numbers is an error, since a lost one would go unnoticed."""
    parts = F.filter(F.transform(F.split(spec, ","), F.trim), lambda p: p != "")

    def one(p: Column) -> Column:
        pair = F.struct(F.split_part(p, F.lit(":"), F.lit(1)).try_cast("long").alias("pos"), F.split_part(p, F.lit(":"), F.lit(2)).try_cast("long").alias("steps"))
        wrong = F.raise_error(F.concat(F.lit("a schedule's entry must be pos:steps, both positive: "), p)).cast("struct<pos:bigint,steps:bigint>")
        return F.when(p.rlike(r"^\s*\+?0*[1-9][0-9]*\s*:\s*\+?0*[1-9][0-9]*\s*$"), pair).otherwise(wrong)

    return F.array_sort(F.transform(parts, one))


def linear_rate(position: Column, first: float, total: float, floor: float) -> Column:
    """A rate that falls in a line to 0 at `total`, but not below a floor."""
    return F.greatest(F.lit(floor), first * F.greatest(F.lit(0.0), 1 - position / total))


def tapered_steps(steps: Column, factor: Column, least: int) -> Column:
    """Steps scaled by a factor, rounded up, between least and steps."""
    return F.greatest(F.lit(least), F.least(steps, F.ceil(steps * F.greatest(F.lit(0.0), factor)))).cast("long")


def ramped_steps(steps: Column, position: Column, every: int, ramp: int) -> Column:
    """One step at first, and one more after each `ramp` boundaries, up to steps."""
    return F.least(steps, 1 + F.floor(F.greatest(F.lit(0), F.floor(position / every) - 1) / ramp)).cast("long")


def stiffness(bits: Column) -> Column:
    """4 to the power of bits - 4; 0 for a channel without bits."""
    return F.when(bits <= 0, 0.0).otherwise(F.pow(F.lit(4.0), bits - 4.0))


def pulled(values: Column, anchor: Column, pull: Column) -> Column:
    """Each value moved toward the anchor by a share of its distance."""
    return F.transform(values, lambda v: v - (v - anchor) * pull)
