"""Count-based symbol predictors: masses, static and prequential rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstone.functions.scalar import mass


def symbol_counts(docs: DataFrame, *keys: str) -> DataFrame:
    """(keys, sym, n): code points of text. Each document is reduced to its distinct ones before the shuffle."""
    sym = F.explode(F.split("text", "")).alias("sym")
    return docs.select(*keys, sym).where("sym <> ''").groupBy(*keys, "sym").agg(F.count("*").alias("n"))


def distribution(counts: DataFrame, key: str) -> DataFrame:
    """(key, sym, mass, cum_lo, cum_hi): integer masses of at least 1, and their running sums in symbol order."""
    whole = Window.partitionBy(key)
    up_to = whole.orderBy("sym").rowsBetween(Window.unboundedPreceding, 0)
    out = counts.withColumn("mass", mass(F.col("n") / F.sum("n").over(whole))).withColumn("cum_hi", F.sum("mass").over(up_to))
    return out.select(key, "sym", "mass", (F.col("cum_hi") - F.col("mass")).alias("cum_lo"), "cum_hi")


def prequential(counts: DataFrame, key: str, segment: str, smoothing: float = 1.0) -> DataFrame:
    """(key, segment, symbols, bits): each segment is coded with the counts of strictly earlier ones.

    counts: (key, segment, sym, n). All segments are scored at once: what a predictor would have
    learned is a running sum, so no state is carried from one segment to the next.
    """
    before = Window.partitionBy(key, "sym").orderBy(segment).rowsBetween(Window.unboundedPreceding, -1)
    seen = counts.withColumn("prior", F.coalesce(F.sum("n").over(before), F.lit(0)))
    totals = counts.groupBy(key, segment).agg(F.sum("n").alias("symbols"))
    earlier = Window.partitionBy(key).orderBy(segment).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("all_prior", F.coalesce(F.sum("symbols").over(earlier), F.lit(0)))
    alphabet = counts.groupBy(key).agg(F.count_distinct("sym").alias("v"))
    joined = seen.join(totals, [key, segment]).join(alphabet, key)
    bits = F.col("n") * -F.log2((F.col("prior") + smoothing) / (F.col("all_prior") + smoothing * F.col("v")))
    return joined.groupBy(key, segment).agg(F.first("symbols").alias("symbols"), F.sum(bits).alias("bits"))
