"""Frames before a chunk, state that is learned from what came before, and schedules over positions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstone.functions.schedules import linear_rate, parsed_schedule, pulled, ramped_steps, stiffness, tapered_steps
from loomstone.operators.ordered import context_frame, replay_end, training_frame
from loomstone.plans.rates import SEGMENT, _prequential_sql, _segments
from loomstone.plans.registry import query
from loomstone.sources.tables import table

STRIDE, BLOCK = 1000, 256


@query(f"""WITH c AS (SELECT doc_id, length(text) AS n, unnest(range(0, length(text), {STRIDE})) AS start FROM documents),
f AS (SELECT *, CASE WHEN start = 0 THEN 1 ELSE start END AS p0, least(n, start + {STRIDE}) AS stop FROM c)
SELECT doc_id, start, p0, greatest(0, p0 - {BLOCK}) AS ctx, stop, CASE WHEN stop >= 2 THEN stop - least({BLOCK}, stop - 1) - 1 END AS x, CASE WHEN stop >= 2 THEN stop - least({BLOCK}, stop - 1) END AS y FROM f""")
def q_context_frames(spark: SparkSession, folder: str) -> DataFrame:
    """For each chunk of a text the context before it, and the last block of what is known at its end as (x, y), y one further."""
    n = F.char_length("text").cast("long")
    chunks = table(spark, folder, "documents").where("text <> ''").select("doc_id", n.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1, F.lit(STRIDE).cast("long"))).alias("start"))
    stop = F.least("n", F.col("start") + STRIDE)
    frame, train = context_frame(F.col("start"), BLOCK), training_frame(stop, BLOCK)
    return chunks.select("doc_id", "start", frame["first"].alias("p0"), frame["context"].alias("ctx"), stop.alias("stop"), train["x"].alias("x"), train["y"].alias("y"))


@query(f"""WITH e AS (SELECT user_id, event_id, lag(event_type, 3) OVER w AS far, lag(event_type, 1) OVER w AS near, lead(event_type) OVER w AS next FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, event_id, concat_ws('>', far, near) AS context, next AS target FROM e""")
def q_sliding_context(spark: SparkSession, folder: str) -> DataFrame:
    """What lies three and one events back, and what is to be predicted: a frame of bounded size that slides."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    x = table(spark, folder, "events")
    return x.select("user_id", "event_id", F.concat_ws(">", F.lag("event_type", 3).over(w), F.lag("event_type", 1).over(w)).alias("context"), F.lead("event_type").over(w).alias("target"))


@query("""WITH c AS (SELECT lang, doc_id // 100 AS seg, count(*) AS n FROM documents GROUP BY ALL)
SELECT a.lang, a.seg, round(sum(b.n * pow(0.5, a.seg - b.seg)), 6) AS state FROM c a JOIN c b ON a.lang = b.lang AND b.seg <= a.seg GROUP BY ALL""")
def q_decayed_counts(spark: SparkSession, folder: str) -> DataFrame:
    """A count that halves with every segment, updated by each: as n / 0.5**seg sums up, no state is carried row by row. Powers are
    kept near 1 by counting segments from 512 segments before, beyond which nothing is left in double precision."""
    c = table(spark, folder, "documents").groupBy("lang", F.floor(F.col("doc_id") / SEGMENT).alias("seg")).agg(F.count("*").alias("n"))
    part = F.floor(F.col("seg") / 512)
    x = c.withColumns({"part": part, "w": F.col("n") * F.pow(F.lit(2.0), F.col("seg") - part * 512)})
    own = F.sum("w").over(Window.partitionBy("lang", "part").orderBy("seg")) * F.pow(F.lit(0.5), F.col("seg") - F.col("part") * 512)
    ends = x.groupBy("lang", "part").agg((F.sum("w") * F.pow(F.lit(0.5), F.lit(512.0))).alias("carry")).withColumn("part", F.col("part") + 1)
    found = x.join(ends, ["lang", "part"], "left")
    carried = F.coalesce("carry", F.lit(0.0)) * F.pow(F.lit(0.5), F.col("seg") - F.col("part") * 512)
    return found.select("lang", "seg", F.round(own + carried, 6).alias("state"))


_CHOICES = (0.25, 1.0, 4.0)


@F.pandas_udf(T.StringType())
def _printed(x: pd.Series) -> pd.Series:
    """Six decimals of the number as it is held in binary, as C prints them: the mean of two rates often lies next to a tie, which Spark's round decides by the decimals shown."""
    return x.map(lambda v: f"{v:012.6f}")


@query("WITH " + ", ".join(f"x{i} AS (WITH {_prequential_sql(str(s))} SELECT lang, seg, {i} AS choice, round(bits / symbols, 6) AS rate FROM b)" for i, s in enumerate(_CHOICES)) + f""",
a AS ({" UNION ALL ".join(f"SELECT * FROM x{i}" for i in range(len(_CHOICES)))}),
p AS (SELECT *, avg(rate) OVER (PARTITION BY lang, choice ORDER BY seg ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS held_out FROM a)
SELECT lang, seg, CAST(split_part(min(printf('%012.6f', held_out) || '|' || choice), '|', 2) AS INTEGER) AS choice, round(min(held_out), 6) AS held_out FROM p WHERE held_out IS NOT NULL GROUP BY lang, seg""")
def q_recent_choice(spark: SparkSession, folder: str) -> DataFrame:
    """For each segment the candidate that did best, on the mean over the two windows before it, ties to the first."""
    from loomstone.operators.predictor import prequential

    counts = _segments(spark, folder)
    tried = [prequential(counts, "lang", "seg", s).select("lang", "seg", F.lit(i).alias("choice"), F.round(F.col("bits") / F.col("symbols"), 6).alias("rate")) for i, s in enumerate(_CHOICES)]
    w = Window.partitionBy("lang", "choice").orderBy("seg").rowsBetween(-2, -1)
    scored = tried[0].unionByName(tried[1]).unionByName(tried[2]).withColumn("held_out", F.avg("rate").over(w)).where("held_out is not null")
    best = scored.groupBy("lang", "seg").agg(F.min(F.struct(_printed("held_out").alias("r"), "choice")).alias("m"), F.min("held_out").alias("h"))
    return best.select("lang", "seg", "m.choice", (F.floor(F.col("h") * 1e6 + 0.5) / 1e6).alias("held_out"))


_WINDOWS = "w AS (SELECT o_custkey, o_orderkey, o_totalprice, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 3 AS win FROM orders)"


@query(f"WITH {_WINDOWS} SELECT o_custkey, count(*) AS windows, CAST(sum(m) // count(*) AS BIGINT) AS mean_of_means FROM (SELECT o_custkey, win, sum(CAST(round(o_totalprice * 100) AS BIGINT)) * 100 // count(*) AS m FROM w WHERE win <> 1 GROUP BY ALL) GROUP BY o_custkey")
def q_probe_loss(spark: SparkSession, folder: str) -> DataFrame:
    """The mean of the windows' means, in whole hundredths of a cent, without the window trained on."""
    win = F.floor((F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1) / 3)
    x = table(spark, folder, "orders").withColumn("win", win).where("win <> 1").groupBy("o_custkey", "win").agg(F.floor(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")) * 100 / F.count("*")).alias("m"))
    return x.groupBy("o_custkey").agg(F.count("*").alias("windows"), F.floor(F.sum("m") / F.count("*")).alias("mean_of_means"))


@query("""SELECT o_orderkey, s AS step, CASE WHEN s = 0 OR least(o_orderkey, 65) >= o_orderkey THEN o_orderkey ELSE 65 + (o_orderkey * 31 + s * 1000003) % (o_orderkey - 64) END AS "end",
  1 + (o_orderkey * 17 + s * 7919) % least(greatest(1, o_orderkey // 64), 8) + greatest(0, greatest(1, o_orderkey // 64) - 8) AS recent FROM orders, (SELECT unnest(range(3)) AS s)""")
def q_replay(spark: SparkSession, folder: str) -> DataFrame:
    """Ends of replayed windows: the newest first, then drawn from all of the past by position and step alone; and chunks drawn from the
    latest eight."""
    x = table(spark, folder, "orders").select("o_orderkey", F.explode(F.array(*[F.lit(k).cast("long") for k in range(3)])).alias("step"))
    key, chunks = F.col("o_orderkey"), F.greatest(F.lit(1).cast("long"), F.floor(F.col("o_orderkey") / 64))
    recent = 1 + F.pmod(key * 17 + F.col("step") * 7919, F.least(chunks, F.lit(8).cast("long"))) + F.greatest(F.lit(0).cast("long"), chunks - 8)
    return x.select("o_orderkey", "step", replay_end(key, F.col("step"), 64).alias("end"), recent.alias("recent"))


@query("""WITH s AS (SELECT o_orderkey, unnest([(500 + o_orderkey % 3) || ':' || (1 + o_orderkey % 4), ' 20:7 ', '']) AS part FROM orders), p AS (SELECT o_orderkey, CAST(split_part(trim(part), ':', 1) AS BIGINT) AS pos, CAST(split_part(part, ':', 2) AS BIGINT) AS steps FROM s WHERE trim(part) <> ''),
l AS (SELECT o_orderkey, string_agg(pos || ':' || steps, ',' ORDER BY pos, steps) AS schedule FROM p GROUP BY o_orderkey)
SELECT o_orderkey, schedule, round(greatest(4e-5, 8e-5 * greatest(0, 1 - o_orderkey / 20000.0)), 10) AS rate, CAST(greatest(2, least(8, ceil(8 * greatest(0, 1 - o_orderkey / 20000.0)))) AS BIGINT) AS taper,
  least(8, 1 + greatest(0, o_orderkey // 100 - 1) // 10) AS ramp FROM orders JOIN l USING (o_orderkey)""")
def q_schedules(spark: SparkSession, folder: str) -> DataFrame:
    """A schedule parsed from text and sorted, a rate that falls in a line, and numbers of steps that taper off and ramp up."""
    key = F.col("o_orderkey")
    spec = F.concat((500 + key % 3).cast("string"), F.lit(":"), (1 + key % 4).cast("string"), F.lit(", 20:7 ,"))
    text = F.array_join(F.transform(parsed_schedule(spec), lambda e: F.concat(e["pos"].cast("string"), F.lit(":"), e["steps"].cast("string"))), ",")
    return table(spark, folder, "orders").select("o_orderkey", text.alias("schedule"), F.round(linear_rate(key, 8e-5, 20000, 4e-5), 10).alias("rate"), tapered_steps(F.lit(8), 1 - key / 20000, 2).alias("taper"), ramped_steps(F.lit(8), key, 100, 10).alias("ramp"))


@query("""WITH b AS (SELECT vec_id, label, CASE vec_id % 4 WHEN 0 THEN 0 ELSE vec_id % 4 + 1 END AS bits, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS w FROM embeddings),
k AS (SELECT *, CASE WHEN bits <= 0 THEN 0.0 ELSE pow(4.0, bits - 4.0) END AS stiff FROM b)
SELECT vec_id, CAST(bits AS INTEGER) AS bits, stiff, round(list_sum(list_transform(w, lambda x: x - (x - 0.25) * 0.5 * stiff)), 6) AS total FROM k""")
def q_anchor_pull(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors pulled toward an anchor, the more so the more bits they have."""
    x = table(spark, folder, "embeddings").select("vec_id", F.when(F.col("vec_id") % 4 == 0, 0).otherwise(F.col("vec_id") % 4 + 1).cast("int").alias("bits"), F.col("embedding").cast("array<double>").alias("w"))
    x = x.withColumn("stiff", stiffness(F.col("bits")))
    total = F.aggregate(pulled(F.col("w"), F.lit(0.25), 0.5 * F.col("stiff")), F.lit(0.0), lambda s, v: s + v)
    return x.select("vec_id", "bits", "stiff", F.round(total, 6).alias("total"))
