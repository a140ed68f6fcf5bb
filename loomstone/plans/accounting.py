"""Rates, checks of sizes and equality, configuration tables and files of metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstone.operators.checks import accepted, overlaid, strict_match
from loomstone.operators.ordered import total_rank
from loomstone.plans.registry import query
from loomstone.sources.shared import scratch
from loomstone.sources.tables import table


@query("""WITH c AS (SELECT source, CAST(sum(length(text)) AS BIGINT) AS symbols, CAST(sum(strlen(text)) AS BIGINT) AS bytes, count(*) AS n FROM documents GROUP BY source)
SELECT source, symbols, round(bytes / symbols, 6) AS bytes_per_symbol, round(2.5 / (bytes / symbols), 6) AS source_rate, CAST(round(symbols * 2.5 / 8) AS BIGINT) AS projected, CAST(bytes AS BIGINT) + n * 8 AS total, bytes + n * 8 = symbols + n * 8 AS plain FROM c""")
def q_rate_annotation(spark: SparkSession, folder: str) -> DataFrame:
    """A rate of 2.5 bits a symbol stated by byte, the size that it projects, and totals with their frames."""
    c = table(spark, folder, "documents").groupBy("source").agg(F.sum(F.char_length("text").cast("long")).alias("symbols"), F.sum(F.octet_length("text").cast("long")).alias("bytes"), F.count("*").alias("n"))
    ratio = F.col("bytes") / F.col("symbols")
    total = F.col("bytes") + F.col("n") * 8
    return c.select("source", "symbols", F.round(ratio, 6).alias("bytes_per_symbol"), F.round(2.5 / ratio, 6).alias("source_rate"), F.round(F.col("symbols") * 2.5 / 8).cast("long").alias("projected"), total.alias("total"), (total == F.col("symbols") + F.col("n") * 8).alias("plain"))


@query("""WITH l AS (SELECT o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN 'nan'::DOUBLE WHEN o_orderkey % 11 = 0 THEN 'inf'::DOUBLE ELSE round(o_totalprice * 100) END AS loss FROM orders)
SELECT o_custkey, CAST(floor(sum(loss) FILTER (WHERE isfinite(loss)) * 100 / count(*) FILTER (WHERE isfinite(loss))) AS BIGINT) AS loss, round(sum(loss) FILTER (WHERE isfinite(loss)) / count(*) FILTER (WHERE isfinite(loss)) / ln(2), 4) AS bits, count(*) FILTER (WHERE NOT isfinite(loss)) AS left_out FROM l GROUP BY o_custkey""")
def q_finite_mean(spark: SparkSession, folder: str) -> DataFrame:
    """Means over finite losses, in whole hundredths and in bits."""
    loss = F.when(F.col("o_orderkey") % 7 == 0, F.lit(float("nan"))).when(F.col("o_orderkey") % 11 == 0, F.lit(float("inf"))).otherwise(F.round(F.col("o_totalprice") * 100))
    finite = ~F.isnan(loss) & (F.abs(loss) < float("inf"))
    total, n = F.sum(F.when(finite, loss)), F.nullif(F.count(F.when(finite, 1)), F.lit(0))
    return table(spark, folder, "orders").groupBy("o_custkey").agg(F.floor(total * 100 / n).alias("loss"), F.round(total / n / F.log(F.lit(2.0)), 4).alias("bits"), F.count(F.when(~finite, 1)).alias("left_out"))


@query("""SELECT label, round(sqrt(avg(d * d)), 6) AS rms, round(sqrt(avg(d * d)) / sqrt(avg(e * e)), 6) AS relative, round(max(abs(d)), 6) AS largest, count(*) FILTER (WHERE abs(d) > 0.02) AS far
FROM (SELECT label, e, e - round(e, 1) AS d FROM (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS e FROM embeddings)) GROUP BY label""")
def q_relative_error(spark: SparkSession, folder: str) -> DataFrame:
    """Error of rounding to one decimal: its RMS, that relative to the values', the largest, and how many are large. Sums over a
    vector come before the shuffle."""
    e = F.transform(F.col("embedding").cast("array<double>"), lambda v: F.struct(v.alias("e"), (v - F.round(v, 1)).alias("d")))
    add = lambda f: F.aggregate("p", F.lit(0.0), lambda s, x: s + f(x))
    x = table(spark, folder, "embeddings").select("label", e.alias("p")).select("label", F.size("p").alias("n"), add(lambda x: x["d"] * x["d"]).alias("dd"), add(lambda x: x["e"] * x["e"]).alias("ee"), F.array_max(F.transform("p", lambda x: F.abs(x["d"]))).alias("most"), F.size(F.filter("p", lambda x: F.abs(x["d"]) > 0.02)).alias("far"))
    rms = F.sqrt(F.sum("dd") / F.sum("n"))
    return x.groupBy("label").agg(F.round(rms, 6).alias("rms"), F.round(rms / F.sqrt(F.sum("ee") / F.sum("n")), 6).alias("relative"), F.round(F.max("most"), 6).alias("largest"), F.sum("far").alias("far"))


@query("SELECT event_type, count(*) AS n, string_agg(DISTINCT CAST(event_id % 8 AS VARCHAR), ',' ORDER BY CAST(event_id % 8 AS VARCHAR)) AS versions, count(*) FILTER (WHERE event_id % 8 IN (3, 4, 5)) AS accepted FROM events GROUP BY event_type")
def q_version_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Manifests in JSON by kind: the versions met, and those that are accepted."""
    text = F.to_json(F.struct(F.lit("LOOM").alias("mark"), (F.col("event_id") % 8).alias("version")))
    m = table(spark, folder, "events").select("event_type", F.from_json(text, "mark string, version long").alias("m"))
    good = accepted(F.col("m.mark"), F.col("m.version"), "LOOM", (3, 4, 5))
    return m.groupBy("event_type").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(F.col("m.version").cast("string"))), ",").alias("versions"), F.count(F.when(good, 1)).alias("accepted"))


@query("""SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN 'given' END, s_name, CASE WHEN c_custkey % 2 = 0 THEN 'best' END, 'last') AS path, coalesce(s_acctbal, c_acctbal) AS rate
FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey""")
def q_overlay(spark: SparkSession, folder: str) -> DataFrame:
    """Settings of an environment laid over those that were kept, and a path by precedence: given, environment, best, last."""
    env = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_acctbal").alias("c_acctbal"), F.col("s_name").alias("env"))
    own = table(spark, folder, "customer").select("c_custkey", "c_acctbal", F.lit(None).cast("string").alias("env"))
    key = F.col("c_custkey")
    path = F.coalesce(F.when(key % 3 == 0, F.lit("given")), "env", F.when(key % 2 == 0, F.lit("best")), F.lit("last"))
    return overlaid(own, env, "c_custkey").select("c_custkey", path.alias("path"), F.col("c_acctbal").alias("rate"))


@query("""SELECT k AS key, CASE WHEN s.s_suppkey IS NULL THEN 'missing' ELSE 'unexpected' END AS what FROM (SELECT c_custkey AS k FROM customer WHERE c_custkey % 5 = 0 AND c_custkey <= 60 UNION SELECT s_suppkey + 1 FROM supplier) a
LEFT JOIN (SELECT s_suppkey + 1 AS s_suppkey FROM supplier) s ON s.s_suppkey = k LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 5 = 0 AND c_custkey <= 60) c ON c_custkey = k WHERE s.s_suppkey IS NULL OR c_custkey IS NULL""")
def q_strict_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Keys that are missing from one side or unexpected on the other."""
    wanted = table(spark, folder, "customer").where("c_custkey % 5 = 0 and c_custkey <= 60").select(F.col("c_custkey").alias("key"))
    return strict_match(wanted, table(spark, folder, "supplier").select((F.col("s_suppkey") + 1).alias("key")), "key")


@query("""SELECT e.vec_id, m.vec_id IS NOT NULL AS masked FROM embeddings e LEFT JOIN (SELECT vec_id, label, CASE WHEN vec_id % 3 = 0 THEN 63 ELSE len(embedding) END AS width FROM embeddings WHERE vec_id % 2 = 0) m
ON m.vec_id = e.vec_id AND m.width = len(e.embedding)""")
def q_shape_join(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors with a mask of their name and of their width; the others are left free."""
    x = table(spark, folder, "embeddings").select("vec_id", F.size("embedding").alias("width"))
    masks = x.where("vec_id % 2 = 0").select("vec_id", F.when(F.col("vec_id") % 3 == 0, 63).otherwise(F.col("width")).alias("width"), F.lit(True).alias("masked"))
    return x.join(masks, ["vec_id", "width"], "left").select("vec_id", F.coalesce("masked", F.lit(False)).alias("masked"))


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text), length(text)) AS same_as FROM documents")
def q_equal_texts(spark: SparkSession, folder: str) -> DataFrame:
    """For each text the first that equals it byte for byte, by hash: only ids and hashes are shuffled, counted before they are joined."""
    x = table(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return x.join(x.groupBy("h").agg(F.min("doc_id").alias("same_as")), "h").select("doc_id", "same_as")


@query("""SELECT kind, member, raw, CAST(row_number() OVER (ORDER BY CASE kind WHEN 'pages' THEN 0 ELSE 1 END, raw DESC, member) AS INTEGER) AS place FROM (
  SELECT 'documents' AS kind, source AS member, CAST(sum(strlen(text)) AS BIGINT) AS raw FROM documents GROUP BY source UNION ALL SELECT 'pages', split_part(url, '/', 3), CAST(sum(strlen(html)) AS BIGINT) FROM pages GROUP BY ALL) WHERE member NOT LIKE '%3%'""")
def q_member_order(spark: SparkSession, folder: str) -> DataFrame:
    """Groups in a set order, the largest member first, without excluded names."""
    part = lambda name, member, text: table(spark, folder, name).groupBy(member.alias("member")).agg(F.sum(F.octet_length(text).cast("long")).alias("raw")).withColumn("kind", F.lit(name))
    every = part("documents", F.col("source"), "text").unionByName(part("pages", F.split_part("url", F.lit("/"), F.lit(3)), "html")).where(~F.col("member").like("%3%"))
    placed = total_rank(every, [F.when(F.col("kind") == "pages", 0).otherwise(1), F.desc("raw"), F.col("member")], scratch(spark, "members"))
    return placed.select("kind", "member", "raw", (F.col("place") + 1).cast("int").alias("place"))


@query("SELECT user_id, arg_max(event_id, ts::VARCHAR || printf('%012d', event_id)) AS newest FROM events WHERE event_type <> 'view' GROUP BY user_id")
def q_newest(spark: SparkSession, folder: str) -> DataFrame:
    """The newest event of each user that isn't excluded by kind, ties to the larger id."""
    return table(spark, folder, "events").where("event_type <> 'view'").groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).alias("m")).select("user_id", "m.event_id").withColumnRenamed("event_id", "newest")


@query("SELECT o_orderkey AS step, o_totalprice AS bpb, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS pass FROM orders WHERE o_orderkey % 5 <> 0")
def q_metrics_jsonl(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics appended to a folder of JSON lines in two passes, with events and broken lines among them, and read back without these."""
    path = scratch(spark, "metrics")
    orders = table(spark, folder, "orders").withColumn("pass", F.when(F.col("o_orderkey") % 2 == 0, 2).otherwise(1))
    metric = F.struct(F.col("o_orderkey").alias("step"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("bpb"), F.when(F.col("o_orderkey") % 10 == 0, F.lit("start")).alias("event"), "pass")
    for k in (1, 2):
        orders.where(F.col("pass") == k).select(metric.alias("m")).select("m.*").write.mode("append").json(path)
    spark.range(3).select(F.concat(F.lit('{"step": '), F.col("id").cast("string")).alias("value")).write.mode("append").text(path)
    found = spark.read.schema("step long, bpb double, event string, pass int").option("mode", "DROPMALFORMED").json(path)
    return found.where("step is not null and bpb is not null and event is null").select("step", "bpb", "pass")


@query("""WITH c AS (SELECT source, count(*) AS docs, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY source)
SELECT source, CASE WHEN bytes % 2 = 0 THEN 'bpe_tokens' ELSE 'bytes' END AS kind, CAST(CASE WHEN bytes % 2 = 0 THEN 4096 ELSE 256 END AS INTEGER) AS vocab, CASE WHEN bytes % 2 = 0 THEN bytes // 2 ELSE bytes END AS symbols,
  source || CASE WHEN bytes % 2 = 0 THEN '.bpe4096' ELSE '.txt' END || ': ' || CASE WHEN bytes % 2 = 0 THEN bytes // 2 ELSE bytes END || ' symbols of ' || CASE WHEN bytes % 2 = 0 THEN 4096 ELSE 256 END || ', ' || docs || ' documents' AS description FROM c""")
def q_sidecars(spark: SparkSession, folder: str) -> DataFrame:
    """Sidecars of sources, written and read as JSON; kind and vocabulary follow from the name, symbols from both, and a line says it all."""
    path = scratch(spark, "sidecars")
    c = table(spark, folder, "documents").groupBy("source").agg(F.count("*").alias("docs"), F.sum(F.octet_length("text").cast("long")).alias("bytes"))
    c.withColumn("name", F.concat("source", F.when(F.col("bytes") % 2 == 0, F.lit(".bpe4096")).otherwise(F.lit(".txt")))).write.json(path)
    side = spark.read.schema("source string, docs long, bytes long, name string").json(path)
    size = F.regexp_extract("name", r"\.bpe(\d+)$", 1)
    is_tokens = F.col("name").rlike(r"\.bpe\d+$")
    side = side.withColumns({"kind": F.when(is_tokens, "bpe_tokens").otherwise("bytes"), "vocab": F.when(is_tokens, size.try_cast("int")).otherwise(256), "symbols": F.when(is_tokens, F.floor(F.col("bytes") / 2)).otherwise(F.col("bytes"))})
    return side.select("source", "kind", "vocab", "symbols", F.format_string("%s: %d symbols of %d, %d documents", "name", "symbols", "vocab", "docs").alias("description"))


@query("""WITH s AS (SELECT event_type, user_id % 4 AS choice, count(*) AS n FROM events GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY event_type) AS total FROM s)
SELECT event_type, string_agg(['0.5x', '1x', '2x', '4x'][choice + 1] || ':' || printf('%.0f', 100.0 * n / total) || '%', ' ' ORDER BY choice) AS shares, printf('%02d:%02d:%02d', CAST(sum(n) AS BIGINT) // 3600, CAST(sum(n) AS BIGINT) // 60 % 60, CAST(sum(n) AS BIGINT) % 60) AS duration FROM t GROUP BY event_type""")
def q_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Shares of choices and a duration as text."""
    s = table(spark, folder, "events").groupBy("event_type", (F.col("user_id") % 4).alias("choice")).agg(F.count("*").alias("n")).withColumn("total", F.sum("n").over(Window.partitionBy("event_type")))
    label = F.concat(F.get(F.array(*map(F.lit, ("0.5x", "1x", "2x", "4x"))), F.col("choice").cast("int")), F.lit(":"), F.format_string("%.0f", 100.0 * F.col("n") / F.col("total")), F.lit("%"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("choice", label.alias("t")))), lambda x: x["t"]), " ")
    n = F.sum("n")
    return s.groupBy("event_type").agg(listed.alias("shares"), F.format_string("%02d:%02d:%02d", F.floor(n / 3600), F.floor(n / 60) % 60, n % 60).alias("duration"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey < 1000 THEN '0.5,1.0,2.0,4.0' ELSE '0.5,1.0,2.0' END AS scales, CASE WHEN o_orderkey % 2 = 0 THEN 'k,step' ELSE 'k' END AS known, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'blob' END AS other FROM orders""")
def q_field_sets(spark: SparkSession, folder: str) -> DataFrame:
    """A ladder of scales with one more at first; fields of an object that are known, and those that aren't."""
    key = F.col("o_orderkey")
    scales = F.array_union(F.array(*map(F.lit, (0.5, 1.0, 2.0))), F.when(key < 1000, F.array(F.lit(4.0))).otherwise(F.array().cast("array<double>")))
    fields = F.json_object_keys(F.when(key % 2 == 0, F.lit('{"step": 1, "k": 2}')).otherwise(F.lit('{"blob": 1, "k": 2}')))
    known = F.array(*map(F.lit, ("k", "step", "bpb")))
    x = table(spark, folder, "orders").select("o_orderkey", F.array_join(scales.cast("array<string>"), ",").alias("scales"), fields.alias("f"))
    return x.select("o_orderkey", "scales", F.array_join(F.array_sort(F.array_intersect("f", known)), ",").alias("known"), F.array_join(F.array_except("f", known), ",").alias("other"))
