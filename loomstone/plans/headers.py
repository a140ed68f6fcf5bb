"""Header records over the events table, one doc for each 2,000 events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.operators.headers import dictionaries, encoded, expanded, side_dictionary
from loomstone.plans.registry import query
from loomstone.sources.tables import table


def uvarint_sql(v: str) -> str:
    n = f"greatest(1, (length(ltrim(bin({v}), '0')) + 6) // 7)"
    return f"array_to_string(list_transform(range({n}), lambda k: printf('%02x', (({v} >> (7 * k)) & 127) + CASE WHEN k < {n} - 1 THEN 128 ELSE 0 END)), '')"


def le_sql(v: str, size: int) -> str:
    return f"array_to_string(list_transform(range({size}), lambda k: printf('%02x', ({v} >> (8 * k)) & 255)), '')"


def zigzag_sql(v: str) -> str:
    return f"(CASE WHEN {v} < 0 THEN -({v}) * 2 + 1 ELSE ({v}) * 2 END)"


def header_lines(spark: SparkSession, folder: str) -> DataFrame:
    user, text = F.col("user_id"), lambda c: c.cast("string")
    second = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    cents = F.round(F.col("value") * 100).cast("long") * F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1)
    parts = [
        F.lit("revision>"),
        F.concat(F.lit("id>"), text(F.col("event_id") * 3 + user % 7)),
        F.concat(F.lit("timestamp>"), F.lpad(text(F.year("ts") % 100), 2, "0"), text(F.dayofyear("ts")), F.lit(":"), text(second)),
        F.lit("contributor>"),
        F.when(user % 5 == 0, F.concat(F.lit("ip>10.0."), text(user % 300), F.lit("."), text(F.col("event_id") % 256))).otherwise(F.concat(F.lit("username>U"), text(user))),
        F.when(user % 5 > 0, F.concat(F.lit("id>"), text(user))),
        F.lit("/contributor>"),
        F.when(F.col("event_type") == "purchase", F.concat(F.lit(">"), text(cents))).when(F.col("event_type") == "click", F.lit("minor/")),
    ]
    rows = table(spark, folder, "events").select(F.floor(F.col("event_id") / 2000).alias("doc"), "event_id", F.posexplode(F.array(*parts)).alias("k", "line"))
    return rows.where("line is not null").select("doc", (F.col("event_id") * 8 + F.col("k")).alias("line_no"), "line")


_LINES = """parts AS (SELECT event_id // 2000 AS doc, event_id, unnest(range(8)) AS k, unnest([
  'revision>', 'id>' || (event_id * 3 + user_id % 7),
  'timestamp>' || lpad(CAST(year(ts) % 100 AS VARCHAR), 2, '0') || dayofyear(ts) || ':' || CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS BIGINT),
  'contributor>', CASE WHEN user_id % 5 = 0 THEN 'ip>10.0.' || (user_id % 300) || '.' || (event_id % 256) ELSE 'username>U' || user_id END,
  CASE WHEN user_id % 5 > 0 THEN 'id>' || user_id END, '/contributor>',
  CASE WHEN event_type = 'purchase' THEN '>' || CAST(round(value * 100) AS BIGINT) * CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END WHEN event_type = 'click' THEN 'minor/' END]) AS line FROM events),
lines AS (SELECT doc, event_id * 8 + k AS line_no, line FROM parts WHERE line IS NOT NULL)"""

_DICTIONARIES = f"""{_LINES}, u AS (SELECT doc, name, row_number() OVER (PARTITION BY doc ORDER BY n DESC, seen) - 1 AS rank FROM (
  SELECT doc, line[10:] AS name, count(*) AS n, min(line_no) AS seen FROM lines WHERE line LIKE 'username>%' GROUP BY ALL HAVING count(*) >= 2) QUALIFY rank < 255),
s AS (SELECT *, lag(line) OVER (PARTITION BY doc ORDER BY line_no) AS after FROM lines),
i AS (SELECT doc, id, row_number() OVER (PARTITION BY doc ORDER BY n DESC, seen) - 1 AS rank FROM (
  SELECT doc, CAST(line[4:] AS BIGINT) AS id, count(*) AS n, min(line_no) AS seen FROM s WHERE line LIKE 'id>%' AND after LIKE 'username>%' GROUP BY ALL HAVING count(*) >= 2) QUALIFY rank < 255)"""

_RAW = f"'0a' || {le_sql('strlen(line)', 2)} || lower(hex(encode(line)))"
_D = zigzag_sql("id - prior")


@query(f"""WITH {_DICTIONARIES}, p AS (SELECT s.*, CASE WHEN line LIKE 'id>%' THEN CAST(line[4:] AS BIGINT) END AS id, CASE WHEN line LIKE 'username>%' THEN line[10:] END AS name,
  CASE WHEN line LIKE 'timestamp>%' THEN regexp_extract(line, '>(..)([0-9]+):([0-9]+)', ['y', 'd', 's']) END AS t,
  CASE WHEN line LIKE 'ip>%' THEN list_transform(string_split(line[4:], '.'), lambda x: CAST(x AS BIGINT)) END AS o, CASE WHEN line LIKE '>%' THEN CAST(line[2:] AS BIGINT) END AS v FROM s),
q AS (SELECT *, last_value(CASE WHEN after = 'revision>' THEN id END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM p)
SELECT q.doc, line_no, CASE line WHEN 'revision>' THEN '01' WHEN 'contributor>' THEN '02' WHEN '/contributor>' THEN '03' ELSE
  CASE WHEN v IS NOT NULL THEN '04' || {uvarint_sql(zigzag_sql('v'))} WHEN q.id IS NOT NULL AND after = 'revision>' AND prior IS NOT NULL THEN '0b' || {uvarint_sql(_D.replace('id - prior', 'q.id - prior'))}
    WHEN q.id IS NOT NULL AND i.rank IS NOT NULL AND after LIKE 'username>%' THEN '0c' || printf('%02x', i.rank) WHEN q.id IS NOT NULL THEN '05' || {uvarint_sql('q.id')}
    WHEN t IS NOT NULL THEN '06' || {le_sql('CAST(t.y AS BIGINT)', 1)} || {le_sql('CAST(t.d AS BIGINT)', 2)} || {le_sql('CAST(t.s AS BIGINT)', 4)}
    WHEN u.rank IS NOT NULL THEN '07' || printf('%02x', u.rank) WHEN q.name IS NOT NULL THEN '08' || printf('%02x', strlen(q.name)) || lower(hex(encode(q.name)))
    WHEN o IS NOT NULL AND list_max(o) <= 255 THEN '09' || array_to_string(list_transform(o, lambda x: printf('%02x', x)), '') ELSE {_RAW} END END AS op
FROM q LEFT JOIN u ON u.doc = q.doc AND u.name = q.name LEFT JOIN i ON i.doc = q.doc AND i.id = q.id""")
def q_header_encode(spark: SparkSession, folder: str) -> DataFrame:
    """Every header line as a record, in hex."""
    lines = header_lines(spark, folder)
    return encoded(lines, *dictionaries(lines)).select("doc", "line_no", F.lower(F.hex("op")).alias("op"))


@query(f"WITH {_LINES} SELECT doc, line_no, line FROM lines")
def q_header_expand(spark: SparkSession, folder: str) -> DataFrame:
    """The lines again, from their records and the dictionaries."""
    lines = header_lines(spark, folder)
    users, ids = dictionaries(lines)
    return expanded(encoded(lines, users, ids), users, ids)


@query(f"""WITH {_DICTIONARIES}, a AS (SELECT doc, printf('%02x', count(*)) || string_agg(printf('%02x', strlen(name)) || lower(hex(encode(name))), '' ORDER BY rank) AS h FROM u GROUP BY doc),
b AS (SELECT doc, printf('%02x', count(*)) || string_agg({uvarint_sql('id')}, '' ORDER BY rank) AS h FROM i GROUP BY doc)
SELECT doc, '4d334832' || coalesce(a.h, '00') || coalesce(b.h, '00') AS side FROM (SELECT DISTINCT doc FROM lines) LEFT JOIN a USING (doc) LEFT JOIN b USING (doc)""")
def q_header_dictionary(spark: SparkSession, folder: str) -> DataFrame:
    lines = header_lines(spark, folder)
    return side_dictionary(lines, *dictionaries(lines)).select("doc", F.lower(F.hex("side")).alias("side"))
