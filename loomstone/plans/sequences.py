"""State, deltas, runs, chunks and frames over ordered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstone.functions.scalar import half_life_rate, uvarint_length, zigzag
from loomstone.operators.ordered import carried, chunk_starts, deltas, runs
from loomstone.plans.registry import query
from loomstone.sources.tables import table


@query("""SELECT event_id, user_id, last_value(CASE WHEN event_type IN ('click', 'purchase') THEN event_type END IGNORE NULLS)
  OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS state FROM events""")
def q_state_carried(spark: SparkSession, folder: str) -> DataFrame:
    state = F.when(F.col("event_type").isin("click", "purchase"), F.col("event_type"))
    return carried(table(spark, folder, "events").select("event_id", "user_id", "event_type"), "user_id", "event_id", state, "state").select("event_id", "user_id", "state")


@query("SELECT event_id, user_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS previous FROM events")
def q_state_previous(spark: SparkSession, folder: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, folder, "events").select("event_id", "user_id", F.lag("event_type").over(w).alias("previous"))


@query("""WITH d AS (SELECT event_id, user_id, event_id - coalesce(lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS delta FROM events)
SELECT event_id, user_id, delta, CASE WHEN delta < 0 THEN -delta * 2 + 1 ELSE delta * 2 END AS zz,
  greatest(1, CAST(ceil(log2((CASE WHEN delta < 0 THEN -delta * 2 + 1 ELSE delta * 2 END) + 1) / 7) AS BIGINT)) AS bytes, event_id AS restored FROM d""")
def q_id_delta(spark: SparkSession, folder: str) -> DataFrame:
    """Ids as zigzag deltas to the user's previous event, their bytes as varints, and the ids restored from the deltas."""
    events = table(spark, folder, "events").select("event_id", "user_id", F.struct("ts", "event_id").alias("at"))
    return deltas(events, "user_id", "at", "event_id").select("event_id", "user_id", "delta", "zz", uvarint_length(F.col("zz")).alias("bytes"), "restored")


@query("SELECT event_id, CAST(year(ts) % 100 AS INTEGER) AS yy, CAST(dayofyear(ts) AS INTEGER) AS doy, CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS INTEGER) AS sec FROM events")
def q_ts_pack(spark: SparkSession, folder: str) -> DataFrame:
    second = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    return table(spark, folder, "events").select("event_id", (F.year("ts") % 100).alias("yy"), F.dayofyear("ts").alias("doy"), second.cast("int").alias("sec"))


@query("""WITH f AS (SELECT *, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM f)
SELECT user_id, min(event_type) AS event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM r GROUP BY user_id, run HAVING count(*) >= 2""")
def q_runs(spark: SparkSession, folder: str) -> DataFrame:
    return runs(table(spark, folder, "events"), "user_id", "event_id", "event_type")


@query("""SELECT doc_id, unnest(range(0, length(text), 1000)) AS start, least(1000, length(text) - unnest(range(0, length(text), 1000))) AS len FROM documents""")
def q_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of 1,000 code points of each document."""
    n = F.char_length("text").cast("long")
    out = table(spark, folder, "documents").select("doc_id", n.alias("n"), F.explode(chunk_starts(n, 1000)).alias("start"))
    return out.select("doc_id", "start", F.least(F.lit(1000).cast("long"), F.col("n") - F.col("start")).alias("len"))


@query("""WITH n AS (SELECT user_id, event_id, row_number() OVER w AS k, sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS m
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT user_id, event_id, CAST(m AS BIGINT) / 8.0::DOUBLE AS trailing FROM n WHERE k % 8 = 0""")
def q_trailing_mean(spark: SparkSession, folder: str) -> DataFrame:
    """The mean of a user's last eight values, in hundredths, at every eighth event."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    out = table(spark, folder, "events").withColumn("k", F.row_number().over(w)).withColumn("trailing", F.sum(F.round(F.col("value") * 100).cast("long")).over(w.rowsBetween(-7, 0)) / 8.0)
    return out.where(F.col("k") % 8 == 0).select("user_id", "event_id", "trailing")


@query("""WITH s(pos, steps) AS (VALUES (500, 2), (2500, 4), (6000, 1), (9000, 8))
SELECT event_id, CAST(ceil(event_id / 100.0) * 100 AS BIGINT) AS boundary, coalesce(steps, 0) AS steps FROM events LEFT JOIN s ON pos > ceil(event_id / 100.0) * 100 - 100 AND pos <= ceil(event_id / 100.0) * 100""")
def q_burst_join(spark: SparkSession, folder: str) -> DataFrame:
    """The first boundary of 100 at or after an event, and the steps scheduled in the 100 up to it: the
    interval join becomes an equality of boundaries."""
    schedule = spark.createDataFrame([(500, 2), (2500, 4), (6000, 1), (9000, 8)], "at long, steps int")
    up = lambda c: (F.ceil(F.col(c) / 100) * 100).cast("long")
    own = table(spark, folder, "events").select("event_id", up("event_id").alias("boundary"))
    return own.join(F.broadcast(schedule.select(up("at").alias("boundary"), "steps")), "boundary", "left").select("event_id", "boundary", F.coalesce("steps", F.lit(0)).alias("steps"))


@query("""SELECT o_orderkey, round(CASE WHEN o_orderkey < 100 THEN 0.0 ELSE greatest(4e-5, 8e-5 * pow(0.5, o_orderkey / 5000.0)) END, 10) AS rate FROM orders""")
def q_half_life_rate(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select("o_orderkey", F.round(half_life_rate(F.col("o_orderkey"), 8e-5, 5000, 4e-5, 100), 10).alias("rate"))


@query("""SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY event_type""")
def q_choice_shares(spark: SparkSession, folder: str) -> DataFrame:
    counted = table(spark, folder, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@query("""WITH d AS (SELECT user_id, event_id, event_id - coalesce(lag(event_id) OVER w, 0) AS delta FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
r AS (SELECT user_id, event_id, sum(delta) OVER (PARTITION BY user_id ORDER BY event_id) AS restored FROM d)
SELECT user_id, count(*) AS n, count(*) FILTER (WHERE restored IS DISTINCT FROM event_id) AS mismatches, min(event_id) FILTER (WHERE restored IS DISTINCT FROM event_id) AS first_mismatch FROM r GROUP BY user_id""")
def q_verify_positional(spark: SparkSession, folder: str) -> DataFrame:
    """Encode, decode, compare: mismatches and the first of them, for each user."""
    out = deltas(table(spark, folder, "events"), "user_id", "event_id", "event_id")
    off = ~F.col("restored").eqNullSafe(F.col("event_id"))
    return out.groupBy("user_id").agg(F.count("*").alias("n"), F.count(F.when(off, 1)).alias("mismatches"), F.min(F.when(off, F.col("event_id"))).alias("first_mismatch"))


@query("""WITH z AS (SELECT c_custkey, CASE WHEN x < 0 THEN -x * 2 + 1 ELSE x * 2 END AS zz FROM (SELECT c_custkey, CAST(round(c_acctbal * 100) AS BIGINT) AS x FROM customer))
SELECT c_custkey, zz, greatest(1, CAST(ceil(log2(zz + 1) / 7) AS BIGINT)) AS bytes FROM z""")
def q_zigzag_bytes(spark: SparkSession, folder: str) -> DataFrame:
    z = zigzag(F.round(F.col("c_acctbal") * 100).cast("long"))
    return table(spark, folder, "customer").select("c_custkey", z.alias("zz"), uvarint_length(z).alias("bytes"))


@query("SELECT user_id, event_id, event_type FROM events")
def q_runs_expanded(spark: SparkSession, folder: str) -> DataFrame:
    """Runs packed to one row with their ids' deltas, and expanded again."""
    packed = runs(table(spark, folder, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type", least=1)
    ids = table(spark, folder, "events").select("user_id", "event_id")
    both = packed.select("user_id", F.col("first").alias("event_id"), "event_type").unionByName(ids.withColumn("event_type", F.lit(None).cast("string")))
    # Where a run begins its row sorts before the plain one, so the last type seen is the run's.
    order = Window.partitionBy("user_id").orderBy("event_id", F.col("event_type").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn("own", F.last("event_type", ignorenulls=True).over(order)).where(F.col("event_type").isNull())
    return filled.select("user_id", "event_id", F.col("own").alias("event_type"))


@query("""WITH w AS (SELECT o_orderkey, unnest(range(1, 6)) AS back FROM orders)
SELECT o_orderkey, back, greatest(0, o_orderkey - back * 64) AS lo, o_orderkey - (back - 1) * 64 AS hi FROM w WHERE o_orderkey - (back - 1) * 64 > 0 AND back <> 2""")
def q_probe_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of 64 that walk back from each position, but for the second, which is the one trained on."""
    ends = table(spark, folder, "orders").select("o_orderkey", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(5).cast("long"))).alias("back"))
    hi = F.col("o_orderkey") - (F.col("back") - 1) * 64
    return ends.withColumn("hi", hi).where("hi > 0 AND back <> 2").select("o_orderkey", "back", F.greatest(F.lit(0).cast("long"), F.col("hi") - 64).alias("lo"), "hi")
