"""Gates, overlays and strict matches of keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def accepted(mark: Column, version: Column, wanted: str, versions: Sequence[int]) -> Column:
    """Whether a mark is the wanted one and its version one of these; null counts as no."""
    return F.coalesce((mark == wanted) & version.isin(*versions), F.lit(False))


def gated(content: Column, good: Column, what: str) -> Column:
    """content where it is good; an error naming what is wrong elsewhere."""
    return F.when(good, content).otherwise(F.raise_error(F.lit(what)))


def overlaid(own: DataFrame, over: DataFrame, key: str) -> DataFrame:
    """own with the values of `over` in place of its own, wherever that has the key and a value that isn't null."""
    names = [c for c in own.columns if c != key]
    joined = own.join(over.select(key, *[F.col(c).alias(f"_{c}") for c in names if c in over.columns]), key, "left")
    return joined.select(key, *[F.coalesce(f"_{c}", c).alias(c) if c in over.columns else F.col(c) for c in names])


def strict_match(wanted: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, what): keys of wanted that found lacks (missing) and the other way round (unexpected); none, if they match."""
    missing = wanted.select(key).distinct().join(found, key, "left_anti").withColumn("what", F.lit("missing"))
    return missing.unionByName(found.select(key).distinct().join(wanted, key, "left_anti").withColumn("what", F.lit("unexpected")))
