"""Line dedup over levelled sorted runs of line hashes.

A run is a table, bucketed and sorted by hash, of the line hashes that a batch of documents brought: how
many of its documents hold the line and, if no earlier run had it, which of them keeps it. A new batch is dealt
into the same buckets and merged with each run where that lies, so that runs are never shuffled for it.
Runs of a level are merged into one of the next when there are enough of them, so a store of
n batches has about log(n) levels and a line is rewritten about log(n) times.
"""

from __future__ import annotations

import string
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm.runtime import materialise, shared_dir

HASH = ["h1", "h2"]
#: A dropped-line table up to so many rows (28 bytes each) is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 500_000
_SPACES = " \t\n\x0b\x0c\r"


def lowered(text: Column) -> Column:
    """A-Z lower-cased, in one pass over the whole text."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    return lowered(F.btrim(line, F.lit(_SPACES)))


def key_hash(key: Column) -> Column:
    """128 bits of a line's key, as a struct of two longs."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(key, F.lit(1)).alias("h2"))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def document_lines(rows: DataFrame, min_chars: int) -> DataFrame:
    """(id, text_hash, pos, h1, h2) of each line of (id, text) whose key has at least min_chars code points."""
    keys = F.transform(lines_of(lowered(F.col("text"))), lambda x, i: F.struct(i.alias("pos"), F.btrim(x, F.lit(_SPACES)).alias("key")))
    long = F.filter(keys, lambda x: F.char_length(x["key"]) >= min_chars)
    found = rows.select("id", text_hash().alias("text_hash"), F.explode(long).alias("line"))
    return found.select("id", "text_hash", F.col("line.pos").alias("pos"), key_hash(F.col("line.key")).alias("h")).select("id", "text_hash", "pos", "h.*")


def text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


class LineRuns:
    """The store: add() takes batches of (id, h1, h2) in any number, lines() gives the merged view.

    Batches must hold different ids. Where they come in descending id, the keeper of a line, set
    by the first batch that has it, is the largest id of all. Runs are tables of the session's
    catalog, their files are in the shared folder.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, fanout: int = 3):
        self.spark, self.fanout = spark, fanout
        self.folder = folder or f"{shared_dir(spark)}/line-runs-{uuid.uuid4().hex}"
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]  # of each level the runs' names

    def _write(self, rows: DataFrame, level: int) -> str:
        name = f"line_run_{level}_{uuid.uuid4().hex}"
        dealt = rows.repartition(self.buckets, *HASH).sortWithinPartitions(*HASH)
        dealt.write.bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def add(self, batch: DataFrame) -> None:
        """Merge-anti-joins the batch with every run: lines that all of them lack are new and get a keeper;
        known ones only add to the number of documents. The result is a run of level 0."""
        own = batch.distinct().groupBy(*HASH).agg(F.count("*").alias("n_docs"), F.max("id").alias("keeper"))
        for run in (run for level in self.levels for run in level):
            known = self.spark.table(run).select(*HASH, F.lit(True).alias("known")).hint("merge")
            own = own.join(known, HASH, "left").select(*HASH, "n_docs", F.when(F.col("known").isNull(), F.col("keeper")).alias("keeper"))
        self.levels[0].append(self._write(own, 0))
        self._compact()

    def _compact(self) -> None:
        for level in range(64):
            if level == len(self.levels) or len(self.levels[level]) < self.fanout:
                return
            merged = self._write(self._merged(self.levels[level]), level + 1)
            self.levels[level] = []
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(merged)

    def _merged(self, runs: list[str]) -> DataFrame:
        # Read as plain files: a union of bucketed tables is not dealt as its parts are, though Spark 4.1 may plan as if it were.
        parts = [self.spark.read.schema("h1 long, h2 long, n_docs long, keeper long").parquet(f"{self.folder}/{run}") for run in runs]
        return reduce(DataFrame.unionByName, parts).groupBy(*HASH).agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"))

    def lines(self) -> DataFrame:
        """(h1, h2, n_docs, keeper) of every line added so far."""
        return self._merged([run for level in self.levels for run in level])


def drop_repeated_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, batches: int = 4) -> DataFrame:
    """docs with text without repeated lines, and n_lines (before), n_dropped.

    A line whose key has at least min_chars code points and is in at least min_docs documents is
    dropped from all but the largest doc_id that holds it, which keeps all its copies. A null or
    empty text is one empty line and comes back empty. A null doc_id is below all others; rows
    with the same doc_id (or null) are one document, but each text is cut by itself, so that no task gathers what is
    dropped from several. If docs has n_lines or n_dropped already, they are replaced; other columns stay. An empty table gives
    no rows. Lines are hashed once; a very long text takes memory for its own lines in one task.
    """
    spark = docs.sparkSession
    # The caller's columns travel in a struct, so that none can clash with those made here.
    rows = docs.drop("n_lines", "n_dropped").select(F.struct("*").alias("_row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("id"), "text")
    lines = materialise(document_lines(rows.select("id", "text"), min_chars), "lines")
    cuts = rows.agg(F.percentile_approx("id", [(i + 1) / batches for i in range(batches - 1)], 1000)).first()[0] or []
    cuts = sorted(set(cuts))
    store = LineRuns(spark)
    for low, high in reversed(list(zip([None, *cuts], [*cuts, None], strict=True))):
        part = lines.select("id", *HASH)
        part = part.where(F.col("id") > low) if low is not None else part
        part = part.where(F.col("id") <= high) if high is not None else part
        store.add(part)
    repeated = materialise(store.lines().where(F.col("n_docs") >= min_docs), "repeated-lines")
    side = repeated.select(*HASH, "keeper")
    side = F.broadcast(side) if repeated.count() <= BROADCAST_ROWS else side
    hits = lines.join(side, HASH).where("id <> keeper")
    drops = hits.groupBy("id", "text_hash").agg(F.collect_set("pos").alias("_drops"))
    parts = lines_of(F.col("text"))
    # Bound as the element of an array of one, so that the text is split once and not for each line.
    kept = F.transform(F.array(parts), lambda p: F.transform(F.array_except(F.sequence(F.lit(0), F.size(p) - 1), F.col("_drops")), lambda i: F.get(p, i)))[0]
    out = rows.withColumn("text_hash", text_hash()).join(drops, ["id", "text_hash"], "left").withColumn("_kept", F.when(F.col("_drops").isNotNull(), kept))
    n = F.size(parts).cast("long")
    text = F.coalesce(F.array_join("_kept", "\n"), "text", F.lit(""))
    row = [text.alias(c) if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return out.select(*row, n.alias("n_lines"), F.coalesce(n - F.size("_kept"), F.lit(0)).cast("long").alias("n_dropped"))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of each row of drop_repeated_lines()."""
    return drop_repeated_lines(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = """
WITH lines AS (
  SELECT doc_id, i, parts[i] AS line,
         translate(trim(parts[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
), repeated AS (
  SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT lines.*, keeper IS NOT NULL AND keeper <> doc_id AS gone FROM lines LEFT JOIN repeated USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
