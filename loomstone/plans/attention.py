"""Causal frames over vectors, rotations, activations, and dequantisation of codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstone.functions.scalar import let
from loomstone.operators.quantise import FP4_MAGNITUDES, dequantised
from loomstone.plans.registry import query
from loomstone.plans.vectors import _X, _vectors
from loomstone.sources.tables import table

BLOCK, HALF = 16, 8


def _dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def _sum(a) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def _partial(q: Column, keys: Column) -> Column:
    """struct(top, mass, total) of the softmax over some keys: the largest score, the sum of weights and of weighted components."""
    scores = F.transform(keys, lambda k: _dot(q, k) / 8)
    return let(scores, lambda s: let(F.array_max(s), lambda top: F.struct(top.alias("top"), _sum(F.transform(s, lambda x: F.exp(x - top))).alias("mass"), _sum(F.zip_with(s, keys, lambda x, k: F.exp(x - top) * _sum(k))).alias("total"))))


_FRAME = f"f AS (SELECT vec_id, x, list(x) OVER (PARTITION BY vec_id // {BLOCK} ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM ({_X}))"


@query(f"""WITH {_FRAME}, e AS (SELECT vec_id, k, list_transform(k, lambda v: exp(list_dot_product(x, v) / 8)) AS w FROM f)
SELECT vec_id, len(k) AS seen, round(list_sum(list_transform(list_zip(k, w), lambda p: list_sum(p[1]) * p[2])) / list_sum(w), 6) AS total FROM e""")
def q_causal_attn(spark: SparkSession, folder: str) -> DataFrame:
    """Attention of each vector over those before it in its block of 16 and itself: partial sums over at most eight keys each, merged in
    order by their largest score."""
    w = Window.partitionBy(F.floor(F.col("vec_id") / BLOCK)).orderBy("vec_id").rowsBetween(Window.unboundedPreceding, 0)
    f = _vectors(spark, folder).withColumn("k", F.collect_list("x").over(w))
    parts = F.transform(F.filter(F.array(F.slice("k", 1, HALF), F.slice("k", HALF + 1, HALF)), lambda p: F.size(p) > 0), lambda keys: _partial(F.col("x"), keys))

    def merge(a: Column, b: Column) -> Column:
        top = F.greatest(a["top"], b["top"])
        scaled = lambda c: a[c] * F.exp(a["top"] - top) + b[c] * F.exp(b["top"] - top)
        return F.struct(top.alias("top"), scaled("mass").alias("mass"), scaled("total").alias("total"))

    whole = let(parts, lambda p: F.aggregate(F.slice(p, F.lit(2), F.size(p)), F.element_at(p, 1), merge))
    return f.select("vec_id", F.size("k").cast("long").alias("seen"), whole.alias("m")).select("vec_id", "seen", F.round(F.col("m.total") / F.col("m.mass"), 6).alias("total"))


@query(f"""WITH p AS (SELECT vec_id // 4 AS pool, list_sum(x) / 4 AS s FROM ({_X})), g AS (SELECT pool, sum(s) AS s FROM p GROUP BY pool),
c AS (SELECT pool, sum(s) OVER (PARTITION BY pool // 64 ORDER BY pool ROWS BETWEEN 8 PRECEDING AND 2 PRECEDING) AS far FROM g),
t AS (SELECT vec_id, sum(list_sum(x)) OVER (PARTITION BY vec_id // 256 ORDER BY vec_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS near FROM ({_X}))
SELECT vec_id, round(coalesce(far, 0), 6) AS far, round(near, 6) AS near FROM t JOIN c ON c.pool = vec_id // 4""")
def q_prefix_tail(spark: SparkSession, folder: str) -> DataFrame:
    """What lies further back pooled by fours, and the last four vectors as they are (sums of components), in stretches of 256."""
    x = _vectors(spark, folder).select("vec_id", _sum("x").alias("s"), F.floor(F.col("vec_id") / 4).alias("pool"))
    far = Window.partitionBy(F.floor(F.col("pool") / 64)).orderBy("pool").rowsBetween(-8, -2)
    pools = x.groupBy("pool").agg((F.sum("s") / 4).alias("p")).withColumn("far", F.sum("p").over(far)).select("pool", "far")
    near = Window.partitionBy(F.floor(F.col("vec_id") / 256)).orderBy("vec_id").rowsBetween(-3, 0)
    tail = x.withColumn("near", F.sum("s").over(near))
    return tail.join(pools, "pool").select("vec_id", F.round(F.coalesce("far", F.lit(0.0)), 6).alias("far"), F.round("near", 6).alias("near"))


@query(f"""WITH a AS (SELECT vec_id, x, list_transform(range(8), lambda i: vec_id % 100 * pow(10000.0, -i / 8.0)) AS t FROM ({_X}) WHERE len(x) >= 16),
r AS (SELECT vec_id, x, list_transform(range(8), lambda i: x[i + 1] * cos(t[i + 1]) + x[i + 9] * sin(t[i + 1])) AS u, list_transform(range(8), lambda i: x[i + 9] * cos(t[i + 1]) - x[i + 1] * sin(t[i + 1])) AS v FROM a)
SELECT vec_id, round(list_sum(u), 6) AS first, round(list_sum(v), 6) AS second, round(list_sum(x[17:]), 6) AS rest FROM r""")
def q_rotary(spark: SparkSession, folder: str) -> DataFrame:
    """The first 16 components turned in pairs by angles that grow with the place, the rest as they are (sums)."""
    x = _vectors(spark, folder).where(F.size("x") >= 16)
    angle = lambda i: F.col("vec_id") % 100 * F.pow(F.lit(10000.0), -i / 8.0)
    half = F.sequence(F.lit(0), F.lit(7))
    first = F.transform(half, lambda i: F.get("x", i) * F.cos(angle(i)) + F.get("x", i + 8) * F.sin(angle(i)))
    second = F.transform(half, lambda i: F.get("x", i + 8) * F.cos(angle(i)) - F.get("x", i) * F.sin(angle(i)))
    return x.select("vec_id", F.round(_sum(first), 6).alias("first"), F.round(_sum(second), 6).alias("second"), F.round(_sum(F.slice("x", F.lit(17), F.size("x"))), 6).alias("rest"))


@query(f"""SELECT vec_id, round(list_sum(list_transform(x, lambda v: CASE WHEN v >= 0 THEN v * v ELSE v * v / 4 END)), 6) AS squared, round(list_sum(list_transform(x, lambda v: v / (1 + exp(-v)))), 6) AS gated,
  round(list_max(list_transform(x, lambda v: CASE WHEN vec_id % 5 = 0 THEN 1.0 / len(x) ELSE exp(v - list_max(x)) / list_sum(list_transform(x, lambda u: exp(u - list_max(x)))) END)), 6) AS chance FROM ({_X})""")
def q_activations(spark: SparkSession, folder: str) -> DataFrame:
    """Squared leaky activations, gates, and the largest chance of a softmax that falls back to equal chances where scores aren't finite."""
    scores = F.when(F.col("vec_id") % 5 == 0, F.transform("x", lambda v: F.lit(float("nan")))).otherwise(F.col("x"))
    finite = lambda s: F.forall(s, lambda v: ~F.isnan(v) & (F.abs(v) < float("inf")))
    chances = lambda s: let(F.array_max(s), lambda top: let(F.transform(s, lambda v: F.exp(v - top)), lambda e: let(_sum(e), lambda z: F.transform(e, lambda v: v / z))))
    p = let(scores, lambda s: F.when(finite(s), chances(s)).otherwise(F.transform(s, lambda _: 1.0 / F.size(s))))
    squared = F.transform("x", lambda v: F.when(v >= 0, v * v).otherwise(v * v / 4))
    return _vectors(spark, folder).select("vec_id", F.round(_sum(squared), 6).alias("squared"), F.round(_sum(F.transform("x", lambda v: v / (1 + F.exp(-v)))), 6).alias("gated"), F.round(F.array_max(p), 6).alias("chance"))


_MODES = ("lloyd", "symmetric", "shared", "fp4", "hybrid_fp4_symmetric")


@query(f"""WITH m AS (SELECT vec_id, unnest([{", ".join(f"'{m}'" for m in _MODES)}]) AS mode, CAST([0, 2, 3, 4][vec_id % 4 + 1] AS INTEGER) AS own, embedding FROM embeddings),
b AS (SELECT *, CASE WHEN mode = 'fp4' AND own > 0 THEN 4 ELSE own END AS bits, 0.125 * (1 + vec_id % 3) AS scale FROM m),
c AS (SELECT *, list_transform(range(len(embedding)), lambda i: (i * 7 + vec_id) % CAST(pow(2, bits) AS BIGINT)) AS codes FROM b),
v AS (SELECT *, list_transform(codes, lambda k: CASE WHEN bits = 0 THEN 0.0
  WHEN mode = 'lloyd' THEN (k * k - 3.0) * scale WHEN bits = 4 AND mode IN ('fp4', 'hybrid_fp4_symmetric') THEN (CASE WHEN k >= 8 THEN -1 ELSE 1 END) * ({list(FP4_MAGNITUDES)})[k % 8 + 1] * scale
  WHEN mode = 'shared' THEN (k - 1.5) * scale ELSE (k - (pow(2, bits) - 1) / 2) * scale END) AS y FROM c)
SELECT mode, bits, count(*) AS channels, CAST(sum(len(y)) AS BIGINT) AS numbers, round(sum(list_sum(y)), 4) AS total, round(sum(list_sum(list_transform(y, lambda z: z * z))), 4) AS squares FROM v GROUP BY mode, bits""")
def q_dequant_modes(spark: SparkSession, folder: str) -> DataFrame:
    """Codes as numbers by every mode of codebook, by bits; a channel without bits is all zeros."""
    own = F.get(F.array(*map(F.lit, (0, 2, 3, 4))), (F.col("vec_id") % 4).cast("int"))
    x = table(spark, folder, "embeddings").select("vec_id", F.size("embedding").alias("n"), own.alias("own"), F.explode(F.array(*map(F.lit, _MODES))).alias("mode"))
    x = x.withColumns({"bits": F.when((F.col("mode") == "fp4") & (F.col("own") > 0), 4).otherwise(F.col("own")), "scale": 0.125 * (1 + F.col("vec_id") % 3)})
    codes = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: ((i * 7 + F.col("vec_id")) % F.pow(F.lit(2.0), "bits").cast("long")).cast("int"))
    levels = F.sequence(F.lit(0), F.pow(F.lit(2.0), F.greatest(F.lit(1), "bits")).cast("int") - 1)
    book = F.when(F.col("mode") == "lloyd", F.transform(levels, lambda k: (k * k - 3.0) * F.col("scale"))).when(F.col("mode") == "shared", F.transform(levels, lambda k: k - 1.5))
    y = x.select("mode", "bits", dequantised(codes, F.col("bits"), F.col("mode"), book, F.col("scale")).alias("y"))
    return y.groupBy("mode", "bits").agg(F.count("*").alias("channels"), F.sum(F.size("y")).alias("numbers"), F.round(F.sum(_sum("y")), 4).alias("total"), F.round(F.sum(_sum(F.transform("y", lambda v: v * v))), 4).alias("squares"))


@query(f"""WITH e AS (SELECT vec_id, label, unnest(range(len(x))) AS i, unnest(x) AS v FROM ({_X}))
SELECT label, i % 8 AS channel, count(*) AS numbers, round(sum(v), 6) AS total FROM e GROUP BY label, i % 8""")
def q_channels(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors as a bank of channels that take every eighth component: its numbers and their sums."""
    x = _vectors(spark, folder).select("label", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda c: F.filter("x", lambda _, i: i % 8 == c))).alias("channel", "v"))
    return x.groupBy("label", F.col("channel").cast("long").alias("channel")).agg(F.sum(F.size("v")).alias("numbers"), F.round(F.sum(_sum("v")), 6).alias("total"))
