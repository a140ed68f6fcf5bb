"""Prefix sums over a global order, from range partitions and their totals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.llm.runtime import materialise


def prefix_sums(df: DataFrame, within: Sequence[str], order: Sequence[Column], values: Mapping[str, Column], name: str) -> DataFrame:
    """Adds, for each new column in values, the sum of its expression over all rows before this one.

    Rows are ordered by order inside each group of the (not null) columns within. The rows are
    dealt into range partitions (as many as there is data for: Spark joins small neighbours), written once, and summed inside each; the partitions' totals
    (a row for each partition and group in it) are summed in turn, so no task holds a group.
    """
    keys = [F.col(c) for c in within]
    parts = materialise(
        df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()).withColumns({f"_{k}": v for k, v in values.items()}), name
    )
    totals = parts.groupBy(*within, "_part").agg(*[F.sum(f"_{k}").alias(f"_sum_{k}") for k in values])
    before = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*within, "_part", *[F.coalesce(F.sum(f"_sum_{k}").over(before), F.lit(0)).alias(f"_from_{k}") for k in values])
    inside = Window.partitionBy(*within, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = parts.withColumns({f"_in_{k}": F.coalesce(F.sum(f"_{k}").over(inside), F.lit(0)) for k in values})
    out = out.join(starts, [*within, "_part"])
    return out.select(*df.columns, *[(F.col(f"_in_{k}") + F.col(f"_from_{k}")).cast("long").alias(k) for k in values])
