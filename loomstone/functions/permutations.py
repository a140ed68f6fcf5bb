"""Lehmer codes of permutations held in arrays, as Column expressions (quadratic in an array's length)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomstone.functions.scalar import let


def lehmer(order: Column) -> Column:
    """For each place of a permutation of 0 .. n - 1 the number of unused values below its own; an error if it is none."""
    valid = F.array_sort(order) == F.when(F.size(order) > 0, F.sequence(F.lit(0), F.size(order) - 1)).otherwise(F.array().cast("array<int>"))
    code = F.transform(order, lambda v, i: v - F.size(F.filter(F.slice(order, F.lit(1), i), lambda u: u < v)))
    return F.when(valid, code).otherwise(F.raise_error(F.lit("not a permutation")).cast("array<int>"))


def unlehmer(code: Column) -> Column:
    """The permutation of a Lehmer code; a number that is too large for its place is an error."""
    none = F.array().cast("array<int>")
    start = lambda c: F.struct(F.when(F.size(c) > 0, F.sequence(F.lit(0), F.size(c) - 1)).otherwise(none).alias("free"), none.alias("out"))

    def step(s: Column, c: Column) -> Column:
        taken = F.when((c >= 0) & (c < F.size(s["free"])), F.get(s["free"], c)).otherwise(F.raise_error(F.lit("not a Lehmer code")).cast("int"))
        return F.struct(F.filter(s["free"], lambda _, i: i != c).alias("free"), F.concat(s["out"], F.array(taken)).alias("out"))

    return let(code, lambda c: F.aggregate(c, start(c), step, lambda s: s["out"]))
