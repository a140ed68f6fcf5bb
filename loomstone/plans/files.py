"""Whole files and word lists as sources, a marker search with a fallback, a table of cached rates, and expansion of tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.plans.rates import _prequential_sql, _segments
from loomstone.plans.registry import query
from loomstone.sources.shared import scratch
from loomstone.sources.tables import byte_files, table


@query("SELECT md5(text) AS hash FROM documents")
def q_byte_files(spark: SparkSession, folder: str) -> DataFrame:
    """Hashes of texts written in files of 1,000 lines at most, which are then read whole, as bytes, and taken apart again. A file whose
    length isn't that of its content is an error."""
    path = scratch(spark, "files")
    table(spark, folder, "documents").select(F.md5("text").alias("value")).write.option("maxRecordsPerFile", 1000).text(path)
    whole = F.when(F.octet_length("content") == F.col("length"), F.decode("content", "UTF-8")).otherwise(F.raise_error(F.lit("a file is cut short")))
    return byte_files(spark, path, "*.txt").select(F.explode(F.split(F.rtrim(whole, F.lit("\n")), "\n")).alias("hash")).where("hash <> ''")


@query("SELECT DISTINCT lower(w) AS word, CAST(length(w) AS INTEGER) AS chars FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM documents) WHERE length(w) <= 58")
def q_word_list(spark: SparkSession, folder: str) -> DataFrame:
    """A list of words as a text file, a word in a line: lower-case, each once, of 58 characters at most."""
    path = scratch(spark, "words")
    words = table(spark, folder, "documents").select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0))).alias("value")).distinct()
    words.write.text(path)
    listed = spark.read.text(path)
    return listed.where(F.char_length("value").between(1, 58)).select(F.col("value").alias("word"), F.char_length("value").alias("chars"))


@query("""WITH d AS (SELECT page_id, html, len(string_split(html, '<p')) - 1 AS dense FROM pages), t AS (SELECT sum(dense) < 1000 AS few FROM d)
SELECT page_id, CASE WHEN few THEN 'line start' ELSE 'dense' END AS kind, CASE WHEN few THEN len(regexp_extract_all(chr(10) || html, '\\n<')) ELSE dense END AS hits FROM d, t""")
def q_marker_search(spark: SparkSession, folder: str) -> DataFrame:
    """Markers of pages; where there are fewer than 1,000 in all, others count instead, at the start of a line."""
    d = table(spark, folder, "pages").select("page_id", (F.size(F.split("html", "<p")) - 1).cast("long").alias("dense"), F.regexp_count(F.concat(F.lit("\n"), "html"), F.lit("\n<")).cast("long").alias("stock"))
    few = F.broadcast(d.agg((F.coalesce(F.sum("dense"), F.lit(0)) < 1000).alias("few")))  # one row
    x = d.crossJoin(few)
    return x.select("page_id", F.when(F.col("few"), "line start").otherwise("dense").alias("kind"), F.when(F.col("few"), F.col("stock")).otherwise(F.col("dense")).alias("hits"))


@query(f"WITH {_prequential_sql()} SELECT doc_id, round(b.bits / b.symbols * length(text), 4) AS bits FROM documents d JOIN b ON b.lang = d.lang AND b.seg = d.doc_id // 100")
def q_cached_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Rates worked out once for each language and segment, kept as a table, and looked up for each document."""
    from loomstone.operators.predictor import prequential

    path = scratch(spark, "rates")
    prequential(_segments(spark, folder), "lang", "seg").select("lang", "seg", (F.col("bits") / F.col("symbols")).alias("rate")).write.parquet(path)
    docs = table(spark, folder, "documents").select("doc_id", "lang", F.floor(F.col("doc_id") / 100).alias("seg"), F.char_length("text").alias("n"))
    return docs.join(spark.read.parquet(path), ["lang", "seg"]).select("doc_id", F.round(F.col("rate") * F.col("n"), 4).alias("bits"))


_TOKENS = """names AS (SELECT CAST(n_nationkey AS BIGINT) + 256 AS id, substr(n_name, 1, 1) AS a, substr(n_name, 2, 1) AS b FROM nation),
m AS (SELECT id, NULL::BIGINT AS l, NULL::BIGINT AS r, a || b AS leaf FROM names UNION ALL SELECT id + 25, id, 256 + (id - 256 + 1) % 25, NULL FROM names UNION ALL SELECT id + 50, id + 25, id, NULL FROM names)"""


@query(f"""WITH {_TOKENS}, e AS (SELECT id, leaf AS text FROM m WHERE leaf IS NOT NULL), f AS (SELECT m.id, x.text || y.text AS text FROM m JOIN e x ON x.id = m.l JOIN e y ON y.id = m.r),
g AS (SELECT m.id, x.text || y.text AS text FROM m JOIN f x ON x.id = m.l JOIN e y ON y.id = m.r) SELECT id, text FROM e UNION ALL SELECT id, text FROM f UNION ALL SELECT id, text FROM g""")
def q_token_expansion(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens made of tokens, down to their text: each round joins what is known to the parts of what isn't, as deep as merges go. The
    table of merges is that of a vocabulary, whose size has a bound."""
    id_ = F.col("n_nationkey").cast("long") + 256
    names = table(spark, folder, "nation").select(id_.alias("id"), F.substring("n_name", 1, 2).alias("leaf"))
    none, part = F.lit(None).cast("long"), lambda i, left, right: names.select(i.alias("id"), left.alias("l"), right.alias("r"), F.lit(None).cast("string").alias("text"))
    i = F.col("id")
    tokens = names.select("id", none.alias("l"), none.alias("r"), F.col("leaf").alias("text")).unionByName(part(i + 25, i, 256 + (i - 256 + 1) % 25)).unionByName(part(i + 50, i + 25, i))
    known, open_ = tokens.where("text is not null").select("id", "text"), tokens.where("text is null").select("id", "l", "r")
    for _ in range(2):  # the depth of these merges
        left, right = known.select(F.col("id").alias("l"), F.col("text").alias("lt")), known.select(F.col("id").alias("r"), F.col("text").alias("rt"))
        found = open_.join(left, "l").join(right, "r").select("id", F.concat("lt", "rt").alias("text"))
        known = known.unionByName(found.join(known.select("id"), "id", "left_anti"))
    return known
