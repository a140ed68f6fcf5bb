"""Packed links, sealed containers, word codes and binary side files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.functions.binary import from_le, from_uvarint, pack_bits, to_le, unpack_bits
from loomstone.functions.scalar import uvarint
from loomstone.operators.dictionary import ranked
from loomstone.operators.links import codes, expanded, packed
from loomstone.operators.quantise import unpack
from loomstone.plans.dictionaries import _WORDS, _words
from loomstone.plans.headers import le_sql, uvarint_sql
from loomstone.plans.registry import query
from loomstone.sources.containers import peel, seal, sealed_or_raw, stream_length, unseal
from loomstone.sources.tables import table


def link_lines(spark: SparkSession, folder: str) -> DataFrame:
    doc_id, text = F.col("doc_id"), lambda c: c.cast("string")
    line = F.concat(F.lit("["), "lang", F.lit(":T]"), text(F.floor(doc_id / 6)), F.lit("]"), F.when(F.floor(doc_id / 12) % 2 == 1, " é").otherwise(""))
    line = F.when(doc_id % 17 == 0, F.concat(F.lit("plain "), text(doc_id))).otherwise(line)
    return table(spark, folder, "documents").select(F.floor(doc_id / 1000).alias("doc"), doc_id.alias("line_no"), line.alias("line"))


_LINKS = """lines AS (SELECT doc_id // 1000 AS doc, doc_id AS line_no, CASE WHEN doc_id % 17 = 0 THEN 'plain ' || doc_id
  ELSE '[' || lang || ':T]' || (doc_id // 6) || ']' || CASE WHEN (doc_id // 12) % 2 = 1 THEN ' é' ELSE '' END END AS line FROM documents)"""


@query(f"""WITH {_LINKS}, p AS (SELECT *, CASE WHEN line LIKE '[%' THEN regexp_extract(line, '^\\[([A-Za-z0-9_-]+):(.*)\\](.*)$', ['code', 'title', 'suffix']) END AS x FROM lines),
c AS (SELECT doc, x.code AS code, row_number() OVER (PARTITION BY doc ORDER BY count(*) DESC, x.code) - 1 AS rank FROM p WHERE x IS NOT NULL GROUP BY doc, x.code QUALIFY rank < 240),
k AS (SELECT p.*, rank, CASE WHEN rank IS NOT NULL AND lag(rank) OVER w IS NOT NULL AND lag(x.title) OVER w = x.title AND lag(x.suffix) OVER w = x.suffix THEN 0 ELSE 1 END AS new
  FROM p LEFT JOIN c ON c.doc = p.doc AND c.code = p.x.code WINDOW w AS (PARTITION BY p.doc ORDER BY line_no)),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc ORDER BY line_no) AS run FROM k),
g AS (SELECT doc, min(line_no) AS first, count(*) AS n, string_agg(printf('%02x', rank), '' ORDER BY line_no) AS ids, lower(hex(encode(any_value(x.title)))) AS title, lower(hex(encode(any_value(x.suffix)))) AS suffix, any_value(line) AS line FROM r GROUP BY doc, run)
SELECT doc, first, CASE WHEN ids IS NULL THEN 'ff' || {le_sql('strlen(line)', 2)} || lower(hex(encode(line))) ELSE
  CASE WHEN n > 1 THEN CASE WHEN suffix <> '' THEN 'fd' ELSE 'fe' END || {uvarint_sql('n')} WHEN suffix <> '' THEN 'f0' ELSE '' END || ids || title || CASE WHEN suffix <> '' THEN '00' || suffix ELSE '' END || '0a' END AS op FROM g""")
def q_interwiki_pack(spark: SparkSession, folder: str) -> DataFrame:
    """Link lines as records, in hex: a title has a bracket of its own, some lines are no links."""
    lines = link_lines(spark, folder)
    return packed(lines, codes(lines)).select("doc", "first", F.lower(F.hex("op")).alias("op"))


@query(f"WITH {_LINKS} SELECT doc, line_no, line FROM lines")
def q_interwiki_expand(spark: SparkSession, folder: str) -> DataFrame:
    lines = link_lines(spark, folder)
    ranks = codes(lines)
    return expanded(packed(lines, ranks), ranks)


@query("""WITH p AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN doc_id || text ELSE text END AS body, 'h ' || lang || chr(10) AS header, '[' || lang || ':' || source || ']' AS lang FROM documents),
s AS (SELECT *, strlen(header) || chr(10) || strlen(lang) || chr(10) || header || lang AS tail, NOT regexp_matches(body, '^[0-9]') AS sealed FROM p)
SELECT doc_id, sealed, sha256(CASE WHEN sealed THEN strlen(tail) || body || tail ELSE body || header || lang END) AS sha256 FROM s""")
def q_container(spark: SparkSession, folder: str) -> DataFrame:
    """Containers, checked by parsing them again; a third of the bodies begin with a digit and are kept raw."""
    body = F.when(F.col("doc_id") % 3 == 0, F.concat(F.col("doc_id").cast("string"), "text")).otherwise(F.col("text"))
    header, lang = F.concat(F.lit("h "), "lang", F.lit("\n")), F.concat(F.lit("["), "lang", F.lit(":"), "source", F.lit("]"))
    docs = table(spark, folder, "documents").select("doc_id", *[x.cast("binary").alias(n) for x, n in ((body, "body"), (header, "header"), (lang, "part"))])
    return docs.select("doc_id", sealed_or_raw(F.col("body"), F.col("header"), F.col("part")).alias("c")).select("doc_id", "c.sealed", F.sha2("c.content", 256).alias("sha256"))


@query("""WITH p AS (SELECT doc_id, text, strlen(text[:100]) AS intro, strlen(text[greatest(101, length(text) - 49):]) AS coda FROM documents)
SELECT doc_id, CAST(1 AS BIGINT) AS version, intro, coda, strlen(text) - intro - coda AS main, strlen(text) AS stream, strlen(text) + 48 AS sealed, sha256(text) AS sha256 FROM p""")
def q_peel(spark: SparkSession, folder: str) -> DataFrame:
    """Texts in three parts, sealed with their sizes, peeled by these and put together again in order."""
    n = F.char_length("text")
    cut = F.greatest(F.lit(101), n - 49)
    parts = [F.substring("text", 1, 100), F.substring(F.col("text"), F.lit(101), F.greatest(F.lit(0), cut - 101)), F.substr(F.col("text"), cut)]
    whole = table(spark, folder, "documents").select("doc_id", seal(*[p.cast("binary") for p in parts]).alias("c"))
    whole = whole.select("doc_id", "c", unseal(F.col("c")).alias("m"), peel(F.col("c")).alias("p"))
    return whole.select("doc_id", "m.*", stream_length(F.col("c")).alias("stream"), F.octet_length("c").cast("long").alias("sealed"), F.sha2(F.concat("p.intro", "p.main", "p.coda"), 256).alias("sha256"))


@query(f"""WITH {_WORDS} SELECT doc_id, count(rank) AS coded, any_value(chars) - CAST(coalesce(sum(CASE WHEN rank IS NOT NULL THEN length(word) - 1 END), 0) AS BIGINT) AS chars, true AS same
FROM (SELECT doc_id, length(text) AS chars FROM documents) LEFT JOIN words USING (doc_id) LEFT JOIN dict USING (word) GROUP BY doc_id""")
def q_word_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Words of the dictionary replaced by one character each, of a range for private use, and put back. A text that has such
    characters itself stays as it is."""
    first, last = 0xE000, 0xE0FE
    private = f"[{chr(first)}-{chr(last)}]"
    words = ranked(_words(spark, folder), "word", "seen", 255).select("word", "rank")  # 255 rows at most, in one row here
    entries = words.select("rank", "word", F.get(F.array(*[F.lit(chr(first + k)) for k in range(255)]), F.col("rank")).alias("code"), F.pmod(F.hash("word"), F.lit(256)).alias("slot"))
    listed = entries.agg(F.array_sort(F.collect_list(F.struct("rank", "word", "code", "slot"))).alias("e"))
    in_slot = lambda k: F.map_from_entries(F.transform(F.filter("e", lambda e: e["slot"] == k), lambda e: F.struct(e["word"], e["code"])))
    coding = listed.select(F.transform("e", lambda e: e["word"]).alias("words"), F.transform(F.sequence(F.lit(0), F.lit(255)), in_slot).alias("slots"))

    # Pieces are looked up in their text's row, so that no text is taken apart into rows and put together by a shuffle.
    docs = table(spark, folder, "documents").select("doc_id", "text", (~F.col("text").rlike(private)).alias("free")).crossJoin(F.broadcast(coding))
    pieces = F.regexp_extract_all("text", F.lit("[A-Za-z]+|[^A-Za-z]+"), 0)
    code = lambda p: F.get(F.col("slots"), F.pmod(F.hash(p), F.lit(256)))[p]
    short = F.when(F.col("free"), F.array_join(F.transform(pieces, lambda p: F.coalesce(code(p), p)), "")).otherwise(F.col("text"))
    out = docs.select("doc_id", "text", "free", "words", short.alias("short"))
    pieces = F.regexp_extract_all("short", F.lit(f"{private}|[^{chr(first)}-{chr(last)}]+"), 0)
    back = F.array_join(F.transform(pieces, lambda p: F.coalesce(F.when(F.ascii(p).between(first, last), F.get(F.col("words"), F.ascii(p) - first)), p)), "")
    coded = F.when(F.col("free"), F.regexp_count("short", F.lit(private))).otherwise(0)
    same = F.when(F.col("free"), back).otherwise(F.col("text")).eqNullSafe(F.col("text"))
    return out.select("doc_id", coded.cast("long").alias("coded"), F.char_length("short").cast("long").alias("chars"), same.alias("same"))


#: The marks of a chunk table and of a merge table.
CHUNKS, MERGES, CHUNK = "BCH1\n", "BBPE1\n", 512


def _list(parts: Column) -> Column:
    """An array of binary as one."""
    return F.unhex(F.array_join(F.transform(parts, F.hex), ""))


@query(f"""WITH t AS (SELECT conv_id, turn, text, list_transform(string_split(text, ''), lambda c: CAST(unicode(c) AS BIGINT) % 65536) AS ids FROM conversations)
SELECT conv_id, turn, len(ids) AS n, sha256(array_to_string(list_transform(ids, lambda x: {le_sql('x', 2)}), '')) AS tokens,
  lower(hex(encode('BCH1' || chr(10)))) || {le_sql(f'((len(ids) + {CHUNK - 1}) // {CHUNK})', 4)} || {le_sql(str(CHUNK), 4)} || array_to_string(list_transform(range(0, len(ids), {CHUNK}), lambda s: {le_sql(f'least({CHUNK}, len(ids) - s)', 4)}), '') AS chunks, true AS same FROM t WHERE text <> ''""")
def q_token_bytes(spark: SparkSession, folder: str) -> DataFrame:
    """Symbols as 16-bit little-endian integers, the table of their chunks' lengths, and both read back."""
    ids = F.transform(F.filter(F.split("text", ""), lambda c: c != ""), lambda c: F.pmod(F.ascii(c), F.lit(65536)).cast("int"))
    rows = table(spark, folder, "conversations").where("text <> ''").select("conv_id", "turn", ids.alias("ids")).withColumn("n", F.size("ids").cast("long"))
    lengths = F.transform(F.sequence(F.lit(0), F.ceil(F.col("n") / CHUNK).cast("int") - 1), lambda k: F.least(F.lit(CHUNK).cast("long"), F.col("n") - k * CHUNK))
    rows = rows.withColumns({"raw": _list(F.transform("ids", lambda x: to_le(x, 2))), "lengths": lengths})
    side = F.concat(F.lit(CHUNKS.encode()), to_le(F.size("lengths"), 4), to_le(F.lit(CHUNK), 4), _list(F.transform("lengths", lambda x: to_le(x, 4))))
    rows = rows.withColumn("side", side)
    even = F.when(F.octet_length("raw") % 2 == 0, (F.octet_length("raw") / 2).cast("int")).otherwise(F.raise_error(F.lit("an odd number of bytes")).cast("int"))
    back = F.transform(F.sequence(F.lit(0), even - 1), lambda k: from_le(F.col("raw"), 2 * k + 1, 2).cast("int"))
    count = from_le(F.col("side"), 6, 4).cast("int")
    again = F.transform(F.sequence(F.lit(0), count - 1), lambda k: from_le(F.col("side"), 4 * k + 14, 4))
    same = (back == F.col("ids")) & (again == F.col("lengths"))
    return rows.select("conv_id", "turn", "n", F.sha2(F.lower(F.hex("raw")), 256).alias("tokens"), F.lower(F.hex("side")).alias("chunks"), same.alias("same"))


@query(f"""WITH s AS (SELECT string_split(text, '') AS x FROM documents), p AS (SELECT unnest(x[:-2]) AS a, unnest(x[2:]) AS b FROM s),
m AS (SELECT unicode(a) % 65536 AS l, unicode(b) % 65536 AS r, count(*) AS n FROM p WHERE b IS NOT NULL GROUP BY a, b HAVING count(*) >= 2 ORDER BY n DESC, a, b LIMIT 64)
SELECT 'BBPE1' AS mark, count(*) AS merges, lower(hex(encode('BBPE1' || chr(10)))) || {le_sql('(256 + count(*))', 4)} || {le_sql('count(*)', 4)} || string_agg({le_sql('l', 4)} || {le_sql('r', 4)}, '' ORDER BY n DESC, l, r) AS bytes FROM m""")
def q_merge_table(spark: SparkSession, folder: str) -> DataFrame:
    """The 64 most frequent pairs as a table of merges in bytes, and its size checked on the way back."""
    from loomstone.plans.rates import _pairs

    top = _pairs(spark, folder).where("n >= 2").orderBy(F.desc("n"), "a", "b").limit(64)  # these 64 rows are the feature
    rows = top.select("n", *[F.pmod(F.ascii(c), F.lit(65536)).cast("long").alias(k) for c, k in (("a", "l"), ("b", "r"))])
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "l", "r")))
    body = _list(F.transform(listed, lambda x: F.concat(to_le(x["l"], 4), to_le(x["r"], 4))))
    whole = rows.agg(F.count("*").alias("merges"), F.concat(F.lit(MERGES.encode()), to_le(256 + F.count("*"), 4), to_le(F.count("*"), 4), body).alias("raw"))
    n = from_le(F.col("raw"), 11, 4)
    good = F.when(F.octet_length("raw") == 14 + 8 * n, F.col("raw")).otherwise(F.raise_error(F.lit("a merge table of another size")).cast("binary"))
    return whole.select(F.lit("BBPE1").alias("mark"), "merges", F.lower(F.hex(good)).alias("bytes"))


@query(f"""WITH x AS (SELECT event_id, user_id, bin(event_id * 37 + user_id) AS bits FROM events)
SELECT event_id, lower(hex(unbin(rpad(bits, CAST((length(bits) + 7) // 8 * 8 AS INTEGER), '0')))) AS packed, bits AS unpacked, {uvarint_sql('event_id')} AS varint, event_id AS number FROM x""")
def q_bits(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers as bits packed highest first, and as varints, both read back."""
    x = table(spark, folder, "events").select("event_id", F.bin(F.col("event_id") * 37 + F.col("user_id")).alias("bits"))
    x = x.select("event_id", "bits", pack_bits(F.col("bits")).alias("raw"), uvarint(F.col("event_id")).alias("v"))
    return x.select("event_id", F.lower(F.hex("raw")).alias("packed"), unpack_bits(F.col("raw"), F.char_length("bits")).alias("unpacked"), F.lower(F.hex("v")).alias("varint"), from_uvarint(F.col("v")).alias("number"))


def _codes_sql(bits: int, n: int) -> str:
    return f"list_transform(range({n}), lambda i: (c >> ({bits} * i)) & {(1 << bits) - 1})"


@query(f"""SELECT event_id, CAST({_codes_sql(2, 12)} AS VARCHAR) AS two, CAST({_codes_sql(3, 8)} AS VARCHAR) AS three, CAST({_codes_sql(4, 6)} AS VARCHAR) AS four
FROM (SELECT event_id, (event_id * 2654435761 + user_id) & 16777215 AS c FROM events)""")
def q_unpack_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Three bytes as codes of 2, 3 and 4 bits, lowest bits first."""
    c = (F.col("event_id") * 2654435761 + F.col("user_id")).bitwiseAND(16777215)
    x = table(spark, folder, "events").select("event_id", to_le(c, 3).alias("raw"))
    listed = lambda bits, n: F.concat(F.lit("["), F.array_join(unpack(F.col("raw"), bits, F.lit(n)).cast("array<string>"), ", "), F.lit("]"))
    return x.select("event_id", listed(2, 12).alias("two"), listed(3, 8).alias("three"), listed(4, 6).alias("four"))
