"""Dictionaries and line parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.functions.scalar import ipv4, upper_median
from loomstone.operators.dictionary import coded, ranked
from loomstone.plans.registry import query
from loomstone.sources.tables import table


def _words(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, word, seen): seen is doc_id * 2**32 and the word's place, as one number: the least of structs would sort all words."""
    start = (F.col("doc_id").cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(10,0)")).alias("start")
    docs = table(spark, folder, "documents").select("doc_id", "text", start)
    words = docs.select("doc_id", "start", F.posexplode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0)).alias("pos", "word"))
    return words.select("doc_id", "word", (F.col("start") + F.col("pos").cast("decimal(10,0)")).alias("seen"))


_WORDS = """words AS (
  SELECT doc_id, w[i] AS word, [doc_id, i - 1] AS seen
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+') AS w FROM documents))
), dict AS (
  SELECT word, cnt, first_seen, row_number() OVER (ORDER BY cnt DESC, first_seen, word) - 1 AS rank
  FROM (SELECT word, count(*) AS cnt, min(seen) AS first_seen FROM words GROUP BY word HAVING count(*) >= 2)
  ORDER BY rank LIMIT 255)"""


@query(f"WITH {_WORDS} SELECT word, cnt, first_seen[1] AS first_doc, first_seen[2] AS first_pos, CAST(rank AS INTEGER) AS rank FROM dict")
def q_dict_top255(spark: SparkSession, folder: str) -> DataFrame:
    places = F.lit(1 << 32).cast("decimal(10,0)")
    pos = F.pmod("first_seen", places)
    doc_id = ((F.col("first_seen") - pos) / places).cast("long")
    return ranked(_words(spark, folder), "word", "seen", 255).select("word", "cnt", doc_id.alias("first_doc"), pos.cast("long").alias("first_pos"), "rank")


@query(f"""WITH {_WORDS} SELECT doc_id, count(rank) AS hits, count(*) - count(rank) AS misses,
  CAST(sum(CASE WHEN rank IS NOT NULL THEN 2 ELSE 2 + strlen(word) END) AS BIGINT) AS encoded_bytes
FROM words LEFT JOIN dict USING (word) GROUP BY doc_id""")
def q_dict_encode_len(spark: SparkSession, folder: str) -> DataFrame:
    words = _words(spark, folder)
    found = coded(words, ranked(words, "word", "seen", 255), "word")
    return found.groupBy("doc_id").agg(F.count("rank").alias("hits"), (F.count("*") - F.count("rank")).alias("misses"), F.sum("bytes").cast("long").alias("encoded_bytes"))


@query("""SELECT user_id, cnt, first_seen, CAST(row_number() OVER (ORDER BY cnt DESC, first_seen, user_id) - 1 AS INTEGER) AS rank
FROM (SELECT user_id, count(*) AS cnt, min(event_id) AS first_seen FROM events GROUP BY user_id HAVING count(*) >= 2)
QUALIFY rank < 255""")
def q_user_rank(spark: SparkSession, folder: str) -> DataFrame:
    return ranked(table(spark, folder, "events"), "user_id", "event_id", 255)


_LINKS = "SELECT doc_id, '[' || lang || ':' || source || ']' || coalesce(regexp_extract(text, '^[A-Za-z]*'), '') AS line FROM documents"


@query(f"""WITH p AS (SELECT regexp_extract(line, '^\\[([A-Za-z0-9_-]+):(.*)\\](.*)$', 1) AS code,
    regexp_extract(line, '^\\[([A-Za-z0-9_-]+):(.*)\\](.*)$', 2) AS title, regexp_extract(line, '^\\[([A-Za-z0-9_-]+):(.*)\\](.*)$', 3) AS suffix FROM ({_LINKS}))
SELECT code, count(*) AS cnt, count(DISTINCT title) AS titles, CAST(sum(length(suffix)) AS BIGINT) AS suffix_chars FROM p GROUP BY code ORDER BY cnt DESC, code LIMIT 240""")
def q_interwiki_codes(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    line = F.concat(F.lit("["), "lang", F.lit(":"), "source", F.lit("]"), F.regexp_extract("text", "^[A-Za-z]*", 0))
    parsed = [F.regexp_extract(line, r"^\[([A-Za-z0-9_-]+):(.*)\](.*)$", k).alias(n) for k, n in ((1, "code"), (2, "title"), (3, "suffix"))]
    counted = docs.select(*parsed).groupBy("code").agg(F.count("*").alias("cnt"), F.count_distinct("title").alias("titles"), F.sum(F.char_length("suffix")).alias("suffix_chars"))
    return counted.orderBy(F.desc("cnt"), "code").limit(240)


_STARTS = """starts AS (
  SELECT page_id, html, s AS start FROM (
    SELECT page_id, html, unnest(list_transform(range(1, len(p)), lambda k: CAST(list_sum(list_transform(p[1:k], lambda x: length(x))) AS BIGINT) + 2 * (k - 1))) AS s
    FROM (SELECT page_id, html, string_split(html, '<p') AS p FROM pages)))"""


@query(f"WITH {_STARTS} SELECT page_id, row_number() OVER w - 1 AS block_no, start, coalesce(lead(start) OVER w, length(html)) - start AS len FROM starts WINDOW w AS (PARTITION BY page_id ORDER BY start)")
def q_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of pages that begin at a marker; text before the first marker is none."""
    return _blocks(spark, folder).select("page_id", F.posexplode("blocks").alias("block_no", "b")).select("page_id", F.col("block_no").cast("long").alias("block_no"), "b.start", "b.len")


def _blocks(spark: SparkSession, folder: str) -> DataFrame:
    parts = F.split("html", "<p")
    lens = F.transform(parts, lambda x: F.char_length(x).cast("long"))
    zero = F.struct(F.element_at("lens", 1).alias("at"), F.array().cast("array<struct<start:bigint,len:bigint>>").alias("out"))
    step = lambda s, n: F.struct((s["at"] + n + 2).alias("at"), F.concat(s["out"], F.array(F.struct(s["at"].alias("start"), (n + 2).alias("len")))).alias("out"))
    pages = table(spark, folder, "pages").withColumn("lens", lens)
    return pages.select("page_id", F.aggregate(F.slice("lens", 2, F.greatest(F.size("lens") - 1, F.lit(0))), zero, step, lambda s: s["out"]).alias("blocks"))


@query(f"""WITH {_STARTS}, gaps AS (SELECT page_id, lead(start) OVER (PARTITION BY page_id ORDER BY start) - start AS gap FROM starts),
l AS (SELECT page_id, list_sort(list(gap)) AS g FROM gaps WHERE gap IS NOT NULL GROUP BY page_id)
SELECT page_id, CASE WHEN g[len(g) // 2 + 1] = 0 THEN 1024 ELSE g[len(g) // 2 + 1] END AS gap FROM l""")
def q_gap_upper_median(spark: SparkSession, folder: str) -> DataFrame:
    gaps = _blocks(spark, folder).where(F.size("blocks") > 1).withColumn("g", F.transform(F.slice("blocks", 1, F.size("blocks") - 1), lambda b: b["len"]))
    return gaps.select("page_id", upper_median(F.col("g")).alias("gap"))


@query("""SELECT user_id, '10.' || (user_id % 300) || '.' || (event_id % 256) || '.' || (event_id % 7) AS addr, event_id,
  CASE WHEN user_id % 300 <= 255 THEN 10::BIGINT * 16777216 + (user_id % 300) * 65536 + (event_id % 256) * 256 + event_id % 7 END AS packed FROM events""")
def q_ipv4(spark: SparkSession, folder: str) -> DataFrame:
    part = lambda c, n: (F.col(c) % n).cast("string")
    addr = F.concat(F.lit("10."), part("user_id", 300), F.lit("."), part("event_id", 256), F.lit("."), part("event_id", 7))
    return table(spark, folder, "events").select("user_id", addr.alias("addr"), "event_id").withColumn("packed", ipv4(F.col("addr")))


@query("""WITH l AS (SELECT doc_id, unnest(CASE WHEN text LIKE '%' || chr(10) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END) AS line FROM documents)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE line = '') AS empty_lines, count(*) FILTER (WHERE regexp_full_match(line, '[0-9]+')) AS digit_lines, CAST(max(length(line)) AS BIGINT) AS longest FROM l GROUP BY doc_id""")
def q_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of each document; one empty line at the end is dropped."""
    parts = F.split("text", "\n")
    lines = F.when(F.endswith("text", F.lit("\n")), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    x = table(spark, folder, "documents").select("doc_id", F.explode(lines).alias("line"))
    count = lambda c: F.count(F.when(c, 1))
    return x.groupBy("doc_id").agg(F.count("*").alias("n_lines"), count(F.col("line") == "").alias("empty_lines"), count(F.col("line").rlike("^[0-9]+$")).alias("digit_lines"), F.max(F.char_length("line")).cast("long").alias("longest"))
