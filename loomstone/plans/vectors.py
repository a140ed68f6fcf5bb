"""Quantisation, pooling and normalisation of vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstone.operators.quantise import fp4, rms_error, symmetric
from loomstone.operators.ordered import total_rank
from loomstone.plans.registry import query
from loomstone.sources.shared import scratch
from loomstone.sources.tables import table


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))


_X = "SELECT vec_id, label, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS x FROM embeddings"
_SCALED = f"SELECT *, list_max(list_transform(x, lambda e: abs(e))) AS top FROM ({_X})"


def _symmetric_sql(bits: int) -> str:
    k = (1 << bits) - 1
    return f"SELECT vec_id, label, x, list_transform(x, lambda e: floor((e + top) / (2 * top) * {k} + 0.5) * 2 * top / {k} - top) AS y FROM ({_SCALED})"


_ERROR = "sqrt(list_sum(list_transform(list_zip(x, y), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) / len(x))"
_MAGNITUDE = "CASE WHEN a < 0.25 THEN 0 WHEN a < 0.75 THEN 0.5 WHEN a < 1.25 THEN 1 WHEN a < 1.75 THEN 1.5 WHEN a < 2.5 THEN 2 WHEN a < 3.5 THEN 3 WHEN a < 5 THEN 4 ELSE 6 END"


@query(f"SELECT vec_id, {', '.join(f'(SELECT round({_ERROR}, 6) FROM ({_symmetric_sql(b)}) q WHERE q.vec_id = e.vec_id) AS rms{b}' for b in (2, 3, 4))} FROM embeddings e")
def q_quant_symmetric(spark: SparkSession, folder: str) -> DataFrame:
    x = _vectors(spark, folder)
    return x.select("vec_id", *[F.round(rms_error(F.col("x"), symmetric(F.col("x"), b)), 6).alias(f"rms{b}") for b in (2, 3, 4)])


@query(f"""WITH u AS (SELECT vec_id, top, unnest(x) AS e FROM ({_SCALED})), w AS (SELECT vec_id, top, e, abs(e) * 6 / top AS a FROM u),
v AS (SELECT vec_id, e, sign(e) * top / 6 * ({_MAGNITUDE}) AS y FROM w)
SELECT vec_id, round(sqrt(avg((e - y) * (e - y))), 6) AS rms FROM v GROUP BY vec_id""")
def q_quant_fp4(spark: SparkSession, folder: str) -> DataFrame:
    return _vectors(spark, folder).select("vec_id", F.round(rms_error(F.col("x"), fp4(F.col("x"))), 6).alias("rms"))


@query(f"""WITH e AS (SELECT label, len(x) AS n, round({_ERROR}, 6) AS rms FROM ({_symmetric_sql(3)})), t AS (SELECT quantile_cont(rms, 0.25) AS lo, quantile_cont(rms, 0.75) AS hi FROM e),
b AS (SELECT label, n, CASE WHEN rms < lo THEN 2 WHEN rms < hi THEN 3 ELSE 4 END AS bits FROM e, t)
SELECT label, bits, count(*) AS vectors, CAST(sum(n) AS BIGINT) AS numbers, CAST(sum(n * bits) AS BIGINT) AS total_bits, round(sum(n * bits) / sum(n), 6) AS average FROM b GROUP BY ROLLUP (label, bits)""")
def q_quant_alloc(spark: SparkSession, folder: str) -> DataFrame:
    """Bits by the rank of a vector's error, and their weighted average, with subtotals."""
    e = _vectors(spark, folder).select("label", F.size("x").cast("long").alias("n"), F.round(rms_error(F.col("x"), symmetric(F.col("x"), 3)), 6).alias("rms"))
    # Quartiles from places over range partitions, so that no task holds all errors.
    ranked = total_rank(e.select("rms"), [F.col("rms")], scratch(spark, "errors"))
    top = F.broadcast(ranked.agg((F.count("*") - 1).alias("last")))  # one row
    value = lambda at: F.max(F.when(F.col("place") == at, F.col("rms")))
    at = lambda share: F.col("last") * share
    ends = ranked.crossJoin(top).groupBy().agg(F.max("last").alias("last"), *[value(f(at(q))).alias(f"{n}{k}") for n, q in (("lo", 0.25), ("hi", 0.75)) for k, f in enumerate((F.floor, F.ceil))])
    between = lambda n, q: F.col(f"{n}0") + (at(q) - F.floor(at(q))) * (F.col(f"{n}1") - F.col(f"{n}0"))
    cuts = F.broadcast(ends.select(between("lo", 0.25).alias("lo"), between("hi", 0.75).alias("hi")))  # one row
    b = e.crossJoin(cuts).withColumn("bits", F.when(F.col("rms") < F.col("lo"), 2).when(F.col("rms") < F.col("hi"), 3).otherwise(4))
    total = F.sum(F.col("n") * F.col("bits"))
    return b.rollup("label", "bits").agg(F.count("*").alias("vectors"), F.sum("n").alias("numbers"), total.cast("long").alias("total_bits"), F.round(total / F.sum("n"), 6).alias("average"))


@query(f"""WITH u AS (SELECT vec_id // 8 AS pool, unnest(range(len(x))) AS dim, unnest(x) AS e FROM ({_X}))
SELECT pool, dim, round(avg(e), 6) AS mean FROM u GROUP BY pool, dim""")
def q_mean_pool(spark: SparkSession, folder: str) -> DataFrame:
    """The mean of every eight vectors."""
    x = _vectors(spark, folder).select(F.floor(F.col("vec_id") / 8).alias("pool"), F.posexplode("x").alias("dim", "e"))
    return x.groupBy("pool", F.col("dim").cast("long").alias("dim")).agg(F.round(F.avg("e"), 6).alias("mean"))


@query(f"""WITH m AS (SELECT vec_id, x, list_max(x) AS top FROM ({_X})), s AS (SELECT vec_id, x, top, list_sum(list_transform(x, lambda e: exp(e - top))) AS z FROM m)
SELECT vec_id, round(list_sum(list_transform(x, lambda e: -exp(e - top) / z * log2(exp(e - top) / z))), 6) AS entropy, list_position(x, top) - 1 AS best FROM s""")
def q_softmax(spark: SparkSession, folder: str) -> DataFrame:
    """Entropy of each vector's softmax, and its largest component, the first if several are."""
    x = _vectors(spark, folder).withColumn("top", F.array_max("x")).withColumn("e", F.transform("x", lambda v: F.exp(v - F.col("top"))))
    z = F.aggregate("e", F.lit(0.0), lambda a, v: a + v)
    p = x.withColumn("z", z).withColumn("p", F.transform("e", lambda v: v / F.col("z")))
    entropy = F.aggregate("p", F.lit(0.0), lambda a, v: a - v * F.log2(v))
    return p.select("vec_id", F.round(entropy, 6).alias("entropy"), (F.array_position("x", F.col("top")) - 1).cast("int").alias("best"))


@query(f"""WITH r AS (SELECT vec_id, x, sqrt(list_sum(list_transform(x, lambda e: e * e)) / len(x) + 1e-6) AS rms FROM ({_X}))
SELECT vec_id, round(list_sum(list_transform(x, lambda e: CASE WHEN e >= 0 THEN 2 * tanh(e / rms / 2) ELSE 3 * tanh(e / rms / 3) END)), 6) AS total FROM r""")
def q_norm_softcap(spark: SparkSession, folder: str) -> DataFrame:
    """RMS normalisation, then tanh limits that differ by sign."""
    from loomstone.functions.scalar import softcap

    x = _vectors(spark, folder).withColumn("rms", F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v) / F.size("x") + 1e-6))
    return x.select("vec_id", F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + softcap(v / F.col("rms"), 2.0, 3.0)), 6).alias("total"))


@query(f"""WITH l AS (SELECT vec_id, x, lag(x) OVER (PARTITION BY label ORDER BY vec_id) AS v FROM ({_X})), d AS (SELECT vec_id, x, v, list_dot_product(x, v) / list_dot_product(v, v) AS c FROM l WHERE v IS NOT NULL)
SELECT vec_id, round(list_sum(list_transform(list_zip(x, v), lambda p: (p[1] - c * p[2]) * (p[1] - c * p[2]))), 6) AS rest FROM d""")
def q_project_out(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of a vector without its projection on the label's vector before it (squared length)."""
    before = F.lag("x").over(Window.partitionBy("label").orderBy("vec_id"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    x = _vectors(spark, folder).withColumn("v", before).where(F.col("v").isNotNull()).withColumn("c", dot("x", "v") / dot("v", "v"))
    rest = F.zip_with("x", "v", lambda p, q: (p - F.col("c") * q) * (p - F.col("c") * q))
    return x.select("vec_id", F.round(F.aggregate(rest, F.lit(0.0), lambda s, v: s + v), 6).alias("rest"))


@query(f"""WITH l AS (SELECT vec_id, x, lag(x) OVER (PARTITION BY label ORDER BY vec_id) AS v FROM ({_X}))
SELECT vec_id, round(list_sum(x) + 0.25 * coalesce(list_sum(v), 0), 6) AS total FROM l""")
def q_smear(spark: SparkSession, folder: str) -> DataFrame:
    """Each vector with a quarter of the label's vector before it mixed in (sum of components)."""
    before = F.lag("x").over(Window.partitionBy("label").orderBy("vec_id"))
    mixed = F.when(before.isNull(), F.col("x")).otherwise(F.zip_with("x", before, lambda a, b: a + 0.25 * b))
    return _vectors(spark, folder).withColumn("m", mixed).select("vec_id", F.round(F.aggregate("m", F.lit(0.0), lambda s, v: s + v), 6).alias("total"))


@query(f"""WITH f AS (SELECT vec_id, x, list(x) OVER (PARTITION BY label ORDER BY vec_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS k FROM ({_X})),
e AS (SELECT vec_id, k, list_transform(k, lambda v: exp(list_dot_product(x, v))) AS w FROM f)
SELECT vec_id, round(list_sum(list_transform(list_zip(k, w), lambda p: list_sum(p[1]) * p[2])) / list_sum(w), 6) AS total FROM e""")
def q_local_attention(spark: SparkSession, folder: str) -> DataFrame:
    """The softmax-weighted mean of a vector and the label's three before it, by their products with it (sum of
    components). The frame is bounded, so a label's rows are streamed, not paired."""
    frame = Window.partitionBy("label").orderBy("vec_id").rowsBetween(-3, 0)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    f = _vectors(spark, folder).withColumn("k", F.collect_list("x").over(frame)).withColumn("w", F.transform("k", lambda v: F.exp(dot(F.col("x"), v))))
    return f.select("vec_id", F.round(add(F.zip_with("k", "w", lambda v, w: add(v) * w)) / add(F.col("w")), 6).alias("total"))
