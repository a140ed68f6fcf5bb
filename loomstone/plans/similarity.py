"""Block features, a total order by similarity with its permutation, near duplicates by SimHash, first merges."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstone.functions.hashing import following_bits, simhash_hex, structural_key_hex
from loomstone.functions.permutations import lehmer, unlehmer
from loomstone.operators.ordered import total_rank
from loomstone.plans.registry import query
from loomstone.sources.shared import scratch
from loomstone.sources.tables import table

_WORD = "18446744073709551616::UHUGEINT"


def _wide(x: str) -> str:
    return f"CAST({x} AS UHUGEINT)"


def splitmix_sql(x: str) -> str:
    """The mixing function on a 64-bit value, by products modulo 2**64."""
    a = f"CAST(({_wide(x)} + 11400714819323198485::UHUGEINT) % {_WORD} AS UBIGINT)"
    step = lambda v, shift, factor: f"list_transform([{v}], lambda z: CAST(({_wide(f'xor(z, z >> {shift}::UBIGINT)')} * {factor}::UHUGEINT) % {_WORD} AS UBIGINT))[1]"
    return f"list_transform([{step(step(a, 30, 13787848793156543929), 27, 10723151780598845931)}], lambda z: xor(z, z >> 31::UBIGINT))[1]"


def features_sql(rows: str) -> str:
    """(id, struct_key, simhash) in hex of rows (id, text), byte by byte."""
    byte = lambda i: f"CAST(('0x' || substr(h, 2 * ({i}) + 1, 2)) AS UBIGINT)"
    first = splitmix_sql("n")
    fold = f"list_reduce(list_prepend({first}, list_transform(range(least(16, n)), lambda i: {byte('i')} << CAST(8 * (i % 8) AS UBIGINT))), lambda s, b: {splitmix_sql('xor(s, b)')})"
    follows = f"list_reduce(list_prepend(0::UBIGINT, list_transform(list_filter(range(1, least(256, n)), lambda i: substr(h, 2 * i - 1, 2) = 'df'), lambda i: 1::UBIGINT << ({byte('i')} & 63::UBIGINT))), lambda s, b: s | b)"
    return f"""r AS (SELECT id, lower(hex(encode(text))) AS h, CAST(strlen(text) AS BIGINT) AS n FROM ({rows})),
k AS (SELECT id, h, n, CASE WHEN n > 16 THEN 12 ELSE 0 END AS skip, {fold} AS f, {follows} AS d FROM r),
y AS (SELECT id, n - skip > 2 AS three, CAST(('0x' || unnest(regexp_extract_all(substr(h, 2 * skip + 1), '..'))) AS UBIGINT) AS a, unnest(range(n - skip)) AS i FROM k),
w AS (SELECT id, three, a, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c FROM y WINDOW o AS (PARTITION BY id ORDER BY i)),
g AS (SELECT id, three, CASE WHEN three THEN (a << 16::UBIGINT) | (b << 8::UBIGINT) | c ELSE a END AS g, count(*) AS c FROM w WHERE NOT three OR c IS NOT NULL GROUP BY ALL),
m AS (SELECT g, three, {splitmix_sql(f"CASE WHEN three THEN CAST(({_wide('g')} * 11400714819323198485::UHUGEINT) % {_WORD} AS UBIGINT) ELSE g END")} AS z FROM (SELECT DISTINCT g, three FROM g)),
s AS (SELECT id, {" | ".join(f"(CASE WHEN 2 * sum(c * CAST((z >> {b}::UBIGINT) & 1::UBIGINT AS BIGINT)) > sum(c) THEN {1 << b}::UBIGINT ELSE 0::UBIGINT END)" for b in range(64))} AS s FROM g JOIN m USING (g, three) GROUP BY id),
features AS (SELECT k.id, printf('%016x', {splitmix_sql('xor(f, d)')}) AS struct_key, printf('%016x', coalesce(s, 0::UBIGINT)) AS simhash, n FROM k LEFT JOIN s USING (id))"""


@query(f"WITH {features_sql('SELECT doc_id AS id, text FROM documents')} SELECT id AS doc_id, CAST(n AS INTEGER) AS len, struct_key, simhash FROM features")
def q_block_features(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.octet_length("text").alias("len"), structural_key_hex("text").alias("struct_key"), simhash_hex("text").alias("simhash"))


@query("""SELECT doc_id, CAST(coalesce(bit_or(CASE WHEN x & 63 < 62 THEN 1::BIGINT << (x & 63) ELSE 0 END), 0) AS BIGINT) AS bits FROM (SELECT doc_id, h, CASE WHEN substr(h, 2 * i + 1, 2) = 'c3' THEN CAST(('0x' || substr(h, 2 * i + 3, 2)) AS BIGINT) END AS x
  FROM (SELECT doc_id, h, unnest(range(greatest(1, least(256, length(h) // 2) - 1))) AS i FROM (SELECT doc_id, lower(hex(encode(text))) AS h FROM documents))) GROUP BY doc_id""")
def q_bitset_or(spark: SparkSession, folder: str) -> DataFrame:
    """Which bytes follow a marker byte near a text's start, as bits of their lowest six (of 62)."""
    return table(spark, folder, "documents").select("doc_id", following_bits(F.col("text"), 0xC3, 256).alias("bits"))


_BLOCKS = """SELECT page_id * 100000 + no AS id, text FROM (SELECT page_id, unnest(range(1, len(p))) AS no, unnest(p[2:]) AS text FROM (SELECT page_id, string_split(html, '<p') AS p FROM pages))"""


def _page_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """(id, b, struct_key, simhash) of the blocks of all pages that follow a marker."""
    parts = table(spark, folder, "pages").select("page_id", F.posexplode(F.split("html", "<p")).alias("no", "b")).where("no > 0")
    return parts.select((F.col("page_id") * 100_000 + F.col("no")).alias("id"), "b", structural_key_hex("b").alias("struct_key"), simhash_hex("b").alias("simhash"))


def _order():
    return [F.col("struct_key"), F.col("simhash"), F.col("id")]


@query(f"WITH {features_sql(_BLOCKS)} SELECT id, struct_key, simhash, row_number() OVER (ORDER BY struct_key, simhash, id) - 1 AS place FROM features")
def q_similarity_order(spark: SparkSession, folder: str) -> DataFrame:
    """Pages' blocks in one order over all of (struct_key, simhash, id): keys are hashes, so the SimHash orders within a key."""
    blocks = _page_blocks(spark, folder).select("id", "struct_key", "simhash")
    return total_rank(blocks, _order(), scratch(spark, "similarity")).select("id", "struct_key", "simhash", F.col("place").cast("long").alias("place"))


@query("SELECT page_id, sha256(html) AS sha256, length(html) AS chars, true AS same FROM pages")
def q_reorder_restore(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks in order of similarity, with what stood before the first of a page, put back where they were. A block that is missing,
    repeated or out of range, or a page whose size has drifted, is an error; each page is whole again."""
    ordered = total_rank(_page_blocks(spark, folder), _order(), scratch(spark, "reorder"))
    pages = table(spark, folder, "pages")
    prelude = pages.select("page_id", F.lit(0).cast("long").alias("no"), F.get(F.split("html", "<p"), F.lit(0)).alias("b"))
    back = ordered.select(F.floor(F.col("id") / 100_000).alias("page_id"), (F.col("id") % 100_000).alias("no"), "b").unionByName(prelude)
    parts = back.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("no", "b"))).alias("p"), F.max("no").alias("last"), F.count_distinct("no").alias("n"))
    fault = F.when(F.size("p") != F.col("n"), "a block is there twice").when(F.col("n") != F.col("last") + 1, "a block is missing or out of range")
    text = F.array_join(F.transform("p", lambda x: x["b"]), "<p")
    found = pages.join(parts, "page_id", "left").withColumn("text", F.when(fault.isNull(), text).otherwise(F.raise_error(fault)))
    kept = F.when(F.octet_length("text") == F.octet_length("html"), F.col("text")).otherwise(F.raise_error(F.lit("a page's size has drifted")))
    return found.select("page_id", F.sha2(kept, 256).alias("sha256"), F.char_length("text").cast("long").alias("chars"), (F.col("text") == F.col("html")).alias("same"))


@query(f"""WITH {features_sql(_BLOCKS)}, p AS (SELECT id // 100000 AS page_id, id, row_number() OVER (PARTITION BY id // 100000 ORDER BY struct_key, simhash, id) - 1 AS pos, id % 100000 - 1 AS orig FROM features),
l AS (SELECT page_id, pos, orig, orig - (SELECT count(*) FROM p q WHERE q.page_id = p.page_id AND q.pos < p.pos AND q.orig < p.orig) AS lehmer FROM p)
SELECT page_id, string_agg(orig::VARCHAR, ',' ORDER BY pos) AS perm, string_agg(lehmer::VARCHAR, ',' ORDER BY pos) AS lehmer, true AS same FROM l GROUP BY page_id""")
def q_lehmer(spark: SparkSession, folder: str) -> DataFrame:
    """The permutation of each page's blocks, its Lehmer code (how many unused numbers lie below each) and the way back."""
    w = Window.partitionBy("page_id").orderBy(*_order())
    rows = _page_blocks(spark, folder).select(F.floor(F.col("id") / 100_000).alias("page_id"), "id", "struct_key", "simhash").withColumn("at", F.row_number().over(w) - 1)
    pages = rows.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", (F.col("id") % 100_000 - 1).cast("int").alias("orig")))), lambda x: x["orig"]).alias("perm"))
    pages = pages.select("page_id", F.col("perm").alias("p"), lehmer(F.col("perm")).alias("l"))
    listed = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return pages.select("page_id", listed("p").alias("perm"), listed("l").alias("lehmer"), (unlehmer(F.col("l")) == F.col("p")).alias("same"))


@query(f"""WITH {features_sql('SELECT doc_id AS id, text FROM documents')}, d AS (SELECT simhash, min(id) AS id FROM features GROUP BY simhash), e AS (SELECT *, CAST(CAST('0x' || simhash AS UBIGINT) AS UHUGEINT)::BIT AS x FROM d)
SELECT a.id AS a, b.id AS b, CAST(bit_count(xor(a.x, b.x)) AS INTEGER) AS bits FROM e a JOIN e b ON a.simhash < b.simhash AND bit_count(xor(a.x, b.x)) <= 3""")
def q_near_dups(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of SimHashes (each named by its first document) that differ in three bits at most. Of six blocks of bits three are equal, so
    pairs are sought among hashes with the same bits in three blocks, for each choice of three. Equal hashes are one, whatever the number of their documents."""
    path = scratch(spark, "simhashes")
    table(spark, folder, "documents").select("doc_id", simhash_hex("text").alias("simhash")).groupBy("simhash").agg(F.min("doc_id").alias("id")).write.parquet(path)
    # Numbers with the highest bit turned over are in order of their hex digits, and differ in the same bits.
    x = spark.read.parquet(path).select("id", F.conv("simhash", 16, -10).cast("long").bitwiseXOR(F.lit(-(1 << 63))).alias("h"))
    return near_pairs(x, 3)


def _masks(differ: int) -> list[int]:
    """Of twice as many blocks of bits as may differ, every choice of half of them, as bits of a signed number."""
    blocks = [sum(1 << i for i in range(k, 64, 2 * differ)) for k in range(2 * differ)]
    return [m - (1 << 64) if m >> 63 else m for m in (sum(c) for c in combinations(blocks, differ))]


def near_pairs(x: DataFrame, differ: int) -> DataFrame:
    """(a, b, bits): ids of rows (id, h), h distinct, that differ in `differ` bits at most, a having the lesser h. A pair comes from the first choice of blocks in which it is equal."""
    masks = _masks(differ)
    spread = x.select("id", "h", F.posexplode(F.array(*[F.col("h").bitwiseAND(F.lit(m)) for m in masks])).alias("choice", "key"))
    a, b = (spread.select("choice", "key", F.col("id").alias(n), F.col("h").alias(f"h{n}")) for n in "ab")
    other = F.col("ha").bitwiseXOR(F.col("hb"))
    first = F.coalesce(*[F.when(other.bitwiseAND(F.lit(m)) == 0, k) for k, m in enumerate(masks)])
    found = a.join(b.hint("merge"), ["choice", "key"]).where((F.col("ha") < F.col("hb")) & (F.bit_count(other) <= differ) & (F.col("choice") == first))
    return found.select("a", "b", F.bit_count(other).alias("bits"))


@query("""WITH s AS (SELECT doc_id, string_split(text, '') AS x FROM documents), p AS (SELECT doc_id, unnest(range(1, len(x))) AS i, unnest(x[:-2]) AS a, unnest(x[2:]) AS b FROM s),
m AS (SELECT a, b, row_number() OVER (ORDER BY count(*) DESC, a, b) - 1 AS rank FROM p WHERE b IS NOT NULL GROUP BY a, b HAVING count(*) >= 2 QUALIFY rank < 1000)
SELECT doc_id, CAST(min(rank) AS BIGINT) AS rank, arg_min(i - 1, rank * 10000000 + i) AS at FROM p JOIN m USING (a, b) GROUP BY doc_id""")
def q_first_merge(spark: SparkSession, folder: str) -> DataFrame:
    """For each text the merge that comes first: the lowest rank among the 1,000 most frequent pairs, at its leftmost place."""
    from loomstone.plans.rates import _pairs

    top = _pairs(spark, folder).where("n >= 2").orderBy(F.desc("n"), "a", "b").limit(1000)
    merges = F.broadcast(top.withColumn("rank", (F.row_number().over(Window.orderBy(F.desc("n"), "a", "b")) - 1).cast("long")).select("a", "b", "rank"))  # 1,000 rows at most
    sym = F.filter(F.split("text", ""), lambda x: x != "")
    docs = table(spark, folder, "documents").select("doc_id", sym.alias("s")).where(F.size("s") > 1)
    pairs = docs.select("doc_id", F.posexplode(F.arrays_zip(F.slice("s", 1, F.size("s") - 1).alias("a"), F.slice("s", 2, F.size("s") - 1).alias("b"))).alias("at", "p"))
    found = pairs.select("doc_id", F.col("at").cast("long").alias("at"), "p.a", "p.b").join(merges, ["a", "b"])
    # Rank and place as one number, of which a task keeps one for each text: the least of structs would sort all pairs.
    least = found.groupBy("doc_id").agg(F.min(F.shiftleft("rank", 32) + F.col("at")).alias("m"))
    return least.select("doc_id", F.shiftright("m", 32).alias("rank"), F.col("m").bitwiseAND((1 << 32) - 1).alias("at"))


@query("SELECT doc_id, row_number() OVER (ORDER BY md5(text), doc_id) - 1 AS place, doc_id AS restored FROM documents")
def q_external_order(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in the order of a table of places, and back by their ids."""
    docs = table(spark, folder, "documents")
    order = total_rank(docs.select("doc_id", F.md5("text").alias("h")), [F.col("h"), F.col("doc_id")], scratch(spark, "order"))
    moved = docs.select("doc_id").join(order.select("doc_id", F.col("place").cast("long").alias("place")), "doc_id")
    return moved.select("doc_id", "place", F.col("doc_id").alias("restored"))
