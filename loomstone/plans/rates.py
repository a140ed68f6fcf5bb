"""Distributions, bits per symbol and size accounting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstone.operators.predictor import distribution, prequential, symbol_counts
from loomstone.plans.registry import query
from loomstone.sources.tables import table

SEGMENT = 100  # documents in a segment

_SYMBOLS = f"s AS (SELECT lang, doc_id // {SEGMENT} AS seg, unnest(string_split(text, '')) AS sym FROM documents)"
_COUNTS = "c AS (SELECT lang, sym, count(*) AS n FROM s WHERE sym <> '' GROUP BY ALL)"


def _segments(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").withColumn("seg", F.floor(F.col("doc_id") / SEGMENT))
    return symbol_counts(docs, "lang", "seg")


@query(f"""WITH {_SYMBOLS}, {_COUNTS}, m AS (SELECT lang, sym, greatest(1, CAST(floor(n / sum(n) OVER (PARTITION BY lang) * 1000000 + 0.5) AS BIGINT)) AS mass FROM c)
SELECT lang, sym, mass, CAST(sum(mass) OVER w - mass AS BIGINT) AS cum_lo, CAST(sum(mass) OVER w AS BIGINT) AS cum_hi FROM m WINDOW w AS (PARTITION BY lang ORDER BY sym)""")
def q_cdf(spark: SparkSession, folder: str) -> DataFrame:
    return distribution(symbol_counts(table(spark, folder, "documents"), "lang"), "lang")


@query(f"""WITH {_SYMBOLS}, {_COUNTS}, p AS (SELECT lang, n, n / sum(n) OVER (PARTITION BY lang) AS p FROM c)
SELECT lang, CAST(sum(n) AS BIGINT) AS symbols, round(sum(n * -log2(greatest(p, 1e-12))) / sum(n), 6) AS bits FROM p GROUP BY lang""")
def q_bits_static(spark: SparkSession, folder: str) -> DataFrame:
    p = F.col("n") / F.sum("n").over(Window.partitionBy("lang"))
    counts = symbol_counts(table(spark, folder, "documents"), "lang").withColumn("p", F.greatest(p, F.lit(1e-12)))
    return counts.groupBy("lang").agg(F.sum("n").alias("symbols"), F.round(F.sum(F.col("n") * -F.log2("p")) / F.sum("n"), 6).alias("bits"))


def _prequential_sql(smoothing: str = "1.0") -> str:
    return f"""{_SYMBOLS}, c AS (SELECT lang, seg, sym, count(*) AS n FROM s WHERE sym <> '' GROUP BY ALL),
k AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY lang, sym ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM c),
t AS (SELECT lang, seg, sum(n) AS symbols FROM c GROUP BY ALL),
u AS (SELECT *, coalesce(sum(symbols) OVER (PARTITION BY lang ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS all_prior FROM t),
v AS (SELECT lang, count(DISTINCT sym) AS v FROM c GROUP BY lang),
b AS (SELECT lang, seg, any_value(symbols) AS symbols, sum(n * -log2((prior + {smoothing}) / (all_prior + {smoothing} * v))) AS bits FROM k JOIN u USING (lang, seg) JOIN v USING (lang) GROUP BY lang, seg)"""


@query(f"WITH {_prequential_sql()} SELECT lang, seg, CAST(symbols AS BIGINT) AS symbols, round(bits / symbols, 6) AS rate FROM b")
def q_bits_prequential(spark: SparkSession, folder: str) -> DataFrame:
    out = prequential(_segments(spark, folder), "lang", "seg")
    return out.select("lang", "seg", "symbols", F.round(F.col("bits") / F.col("symbols"), 6).alias("rate"))


@query(f"""WITH {_prequential_sql()} SELECT lang, seg, round(sum(bits) OVER w / sum(symbols) OVER w, 6) AS so_far,
  round(avg(bits / symbols) OVER (PARTITION BY lang ORDER BY seg ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) AS trailing, round(min(bits / symbols) OVER w, 6) AS best FROM b WINDOW w AS (PARTITION BY lang ORDER BY seg)""")
def q_rate_curve(spark: SparkSession, folder: str) -> DataFrame:
    w = Window.partitionBy("lang").orderBy("seg").rowsBetween(Window.unboundedPreceding, 0)
    rate = F.col("bits") / F.col("symbols")
    out = prequential(_segments(spark, folder), "lang", "seg")
    last = Window.partitionBy("lang").orderBy("seg").rowsBetween(-3, 0)
    return out.select("lang", "seg", F.round(F.sum("bits").over(w) / F.sum("symbols").over(w), 6).alias("so_far"), F.round(F.avg(rate).over(last), 6).alias("trailing"), F.round(F.min(rate).over(w), 6).alias("best"))


_SMOOTHINGS = (0.25, 1.0, 4.0)


@query("WITH " + ", ".join(f"x{i} AS (WITH {_prequential_sql(str(s))} SELECT lang, {i} AS choice, round(sum(bits) / sum(symbols), 6) AS rate FROM b GROUP BY lang)" for i, s in enumerate(_SMOOTHINGS)) + f""",
a AS ({" UNION ALL ".join(f"SELECT * FROM x{i}" for i in range(len(_SMOOTHINGS)))})
SELECT lang, arg_min(choice, rate * 1000 + choice * 1e-9) AS choice, min(rate) AS rate FROM a GROUP BY lang""")
def q_best_smoothing(spark: SparkSession, folder: str) -> DataFrame:
    """Of three candidate predictors the one with the lowest rate, ties to the first, for each language."""
    counts = _segments(spark, folder)
    tried = [
        prequential(counts, "lang", "seg", s).groupBy("lang").agg(F.round(F.sum("bits") / F.sum("symbols"), 6).alias("rate")).withColumn("choice", F.lit(i)) for i, s in enumerate(_SMOOTHINGS)
    ]
    every = tried[0].unionByName(tried[1]).unionByName(tried[2])
    return every.groupBy("lang").agg(F.min(F.struct("rate", "choice")).alias("m")).select("lang", "m.choice", "m.rate")




def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    sym = F.filter(F.split("text", ""), lambda x: x != "")
    docs = table(spark, folder, "documents").withColumn("s", sym).where(F.size("s") > 1)
    pair = F.explode(F.arrays_zip(F.slice("s", 1, F.size("s") - 1).alias("a"), F.slice("s", 2, F.size("s") - 1).alias("b")))
    return docs.select(pair.alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n"))


@query("WITH s AS (SELECT string_split(text, '') AS x FROM documents), p AS (SELECT unnest(x[:-2]) AS a, unnest(x[2:]) AS b FROM s) SELECT a, b, count(*) AS n FROM p WHERE b IS NOT NULL GROUP BY a, b")
def q_pair_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Adjacent code points, overlapping, within documents."""
    return _pairs(spark, folder)


@query("WITH s AS (SELECT string_split(text, '') AS x FROM documents), p AS (SELECT unnest(x[:-2]) AS a, unnest(x[2:]) AS b FROM s) SELECT a, b, count(*) AS n FROM p WHERE b IS NOT NULL GROUP BY a, b HAVING count(*) >= 2 ORDER BY n DESC, a, b LIMIT 1")
def q_best_pair(spark: SparkSession, folder: str) -> DataFrame:
    return _pairs(spark, folder).where("n >= 2").orderBy(F.desc("n"), "a", "b").limit(1)


@query("""WITH f AS (SELECT 'documents' AS kind, source AS member, strlen(text) AS bytes FROM documents
  UNION ALL SELECT 'pages', split_part(url, '/', 3), strlen(html) FROM pages UNION ALL SELECT 'conversations', role, strlen(text) FROM conversations)
SELECT kind, member, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes, round(sum(bytes) / (SELECT sum(bytes) FROM f), 6) AS share FROM f GROUP BY ROLLUP (kind, member)""")
def q_size_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes by kind and member, with subtotals and the total."""
    part = lambda name, kind, member, text: table(spark, folder, name).select(F.lit(kind).alias("kind"), member.alias("member"), F.octet_length(text).cast("long").alias("bytes"))
    every = part("documents", "documents", F.col("source"), "text")
    every = every.unionByName(part("pages", "pages", F.split_part("url", F.lit("/"), F.lit(3)), "html")).unionByName(part("conversations", "conversations", F.col("role"), "text"))
    rolled = every.rollup("kind", "member").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    # The grand total is the largest of the rolled-up sums.
    return rolled.withColumn("share", F.round(F.col("bytes") / F.max("bytes").over(Window.partitionBy()), 6))


@query("SELECT source, count(*) AS n, CAST(sum(strlen(text)) AS BIGINT) AS bytes, CAST(sum(strlen(text)) AS BIGINT) - 100000 AS over, sum(strlen(text)) <= 100000 AS ok FROM documents GROUP BY source")
def q_stage_bar(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes against a bar."""
    size = table(spark, folder, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes"))
    return size.withColumn("over", F.col("bytes") - 100000).withColumn("ok", F.col("bytes") <= 100000)


@query("SELECT doc_id, strlen(text) AS bytes, sha256(text) AS sha256, sha1(text) AS sha1, md5(text) AS md5 FROM documents")
def q_checksums(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.octet_length("text").cast("long").alias("bytes"), F.sha2("text", 256).alias("sha256"), F.sha1("text").alias("sha1"), F.md5("text").alias("md5"))
