"""Relational breadth on the star schema: joins, grouping sets, windows, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstone.plans.registry import query
from loomstone.sources.tables import table
from loomstone.streaming.segments import batch_segments, stream_segments

_CENTS = "CAST(round(l_extendedprice * 100) AS BIGINT)"


def _cents(c: str):
    return F.round(F.col(c) * 100).cast("long")


@query(f"""SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS BIGINT) AS quantity, CAST(sum({_CENTS}) AS BIGINT) AS cents, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""")
def q_pricing_summary(spark: SparkSession, folder: str) -> DataFrame:
    x = table(spark, folder, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return x.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("long").alias("quantity"), F.sum(_cents("l_extendedprice")).alias("cents"), F.count("*").alias("n"))


@query(f"""SELECT r_name, n_name, o_orderpriority, CAST(sum({_CENTS}) AS BIGINT) AS cents, count(DISTINCT o_orderkey) AS orders
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY ALL""")
def q_star_join(spark: SparkSession, folder: str) -> DataFrame:
    t = lambda n: table(spark, folder, n)
    # Lines are summed by order before the joins: the widest table is shuffled once, by the key that it is joined on.
    lines = t("lineitem").groupBy("l_orderkey").agg(F.sum(_cents("l_extendedprice")).alias("cents"))
    x = lines.join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    x = x.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return x.groupBy("r_name", "n_name", "o_orderpriority").agg(F.sum("cents").alias("cents"), F.count("*").alias("orders"))


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def q_anti_join(spark: SparkSession, folder: str) -> DataFrame:
    """Customers without an order that is in part done."""
    orders = table(spark, folder, "orders").where("o_orderstatus = 'P'").select("o_custkey")
    return table(spark, folder, "customer").join(orders, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey", "c_name")


@query("SELECT p_partkey, p_brand FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 49)")
def q_semi_join(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").where("l_quantity >= 49").select("l_partkey")
    return table(spark, folder, "part").join(lines, F.col("l_partkey") == F.col("p_partkey"), "left_semi").select("p_partkey", "p_brand")


@query("""WITH k AS (SELECT DISTINCT c_nationkey AS k, 'c' AS s FROM customer), l AS (SELECT DISTINCT s_nationkey AS k FROM supplier)
SELECT n_name, k.k IS NOT NULL AS buys, l.k IS NOT NULL AS sells FROM nation LEFT JOIN k ON k.k = n_nationkey LEFT JOIN l ON l.k = n_nationkey""")
def q_outer_join(spark: SparkSession, folder: str) -> DataFrame:
    buys = table(spark, folder, "customer").select(F.col("c_nationkey").alias("n_nationkey")).distinct().withColumn("buys", F.lit(True))
    sells = table(spark, folder, "supplier").select(F.col("s_nationkey").alias("n_nationkey")).distinct().withColumn("sells", F.lit(True))
    x = table(spark, folder, "nation").join(buys, "n_nationkey", "left").join(sells, "n_nationkey", "left")
    return x.select("n_name", F.coalesce("buys", F.lit(False)).alias("buys"), F.coalesce("sells", F.lit(False)).alias("sells"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def q_cube(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("quantity"))


@query("""SELECT o_custkey, o_orderkey, CAST(rank AS INTEGER) AS rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3""")
def q_top_per_key(spark: SparkSession, folder: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, folder, "orders").withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("o_custkey", "o_orderkey", "rank")


@query("""SELECT a.event_id, b.event_id AS click FROM events a ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') b ON a.user_id = b.user_id AND a.event_id > b.event_id WHERE a.event_type = 'purchase'""")
def q_asof_join(spark: SparkSession, folder: str) -> DataFrame:
    """For each purchase the user's last click before it: a union and a running maximum, so no range of pairs is made."""
    x = table(spark, folder, "events").where(F.col("event_type").isin("click", "purchase"))
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    click = F.max(F.when(F.col("event_type") == "click", F.col("event_id"))).over(w)
    return x.withColumn("click", click).where("event_type = 'purchase'").select("event_id", "click")


@query("""SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(event_id) AS first FROM (
  SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (SELECT *, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) <= 3600 THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, session""")
def q_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """A new session after an hour without events."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000
    new = F.when(at - F.lag(at).over(w) <= 3600, 0).otherwise(1)
    x = table(spark, folder, "events").withColumn("new", new).withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


@query("(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL (SELECT n_nationkey + 1000 FROM nation EXCEPT SELECT c_nationkey + 1000 FROM customer)")
def q_set_operations(spark: SparkSession, folder: str) -> DataFrame:
    c, s, n = (table(spark, folder, t).select(F.col(k).alias("k")) for t, k in (("customer", "c_nationkey"), ("supplier", "s_nationkey"), ("nation", "n_nationkey")))
    return c.intersect(s).unionAll(n.select((F.col("k") + 1000).alias("k")).subtract(c.select((F.col("k") + 1000).alias("k"))))


@query("""SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY o_orderpriority""")
def q_pivot(spark: SparkSession, folder: str) -> DataFrame:
    x = table(spark, folder, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count()
    return x.select("o_orderpriority", *[F.coalesce(c, F.lit(0).cast("long")).alias(c.lower()) for c in "FOP"])


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) // 10 AS decile, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY ALL")
def q_json_props(spark: SparkSession, folder: str) -> DataFrame:
    """Events by a number in their JSON."""
    k = F.from_json("props", "k long")["k"]
    return table(spark, folder, "events").groupBy("event_type", F.floor(k / 10).alias("decile")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


_SEGMENTS = """SELECT user_id, (k - 1) // 16 AS seg, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents, max(event_id) AS last
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) GROUP BY ALL HAVING count(*) = 16"""


@query(_SEGMENTS)
def q_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Full segments of 16 events of a user, as a batch."""
    return batch_segments(table(spark, folder, "events"))


@query(_SEGMENTS)
def q_segments_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The same from a stream, with the open segment as state."""
    return stream_segments(spark, folder)
