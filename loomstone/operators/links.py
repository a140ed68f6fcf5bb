"""Packing of link lines: [code:title]suffix with ranked codes, and one record for a run of lines that differ in their code alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstone.functions.binary import byte_at, from_uvarint, to_le
from loomstone.functions.scalar import uvarint

#: Fixed values of the format: codes at most, and the first bytes of records that aren't one plain line.
CODES, WITH_SUFFIX, RUN_WITH_SUFFIX, RUN, RAW, LONGEST_LINE = 240, 0xF0, 0xFD, 0xFE, 0xFF, 65535


def parsed(lines: DataFrame) -> DataFrame:
    """Adds code, title and suffix, null where a line isn't a link. A title goes up to the last bracket."""
    part = lambda k: F.when(F.col("_link"), F.regexp_extract("line", r"^\[([A-Za-z0-9_-]+):(.*)\](.*)$", k))
    link = F.col("line").rlike(r"^\[[A-Za-z0-9_-]+:[^\x00]*\][^\x00]*$") & ~F.contains("line", F.lit("\n"))
    return lines.withColumn("_link", link).withColumns({"code": part(1), "title": part(2), "suffix": part(3)}).drop("_link")


def codes(lines: DataFrame) -> DataFrame:
    """(doc, code, rank): of each doc the CODES most frequent codes, ties by their bytes."""
    counted = parsed(lines).where("code is not null").groupBy("doc", "code").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("n"), "code")) - 1
    return counted.withColumn("rank", rank).where(F.col("rank") < CODES).select("doc", "code", "rank")


def packed(lines: DataFrame, ranked: DataFrame) -> DataFrame:
    """(doc, first, op) for lines (doc, line_no, line) numbered without gaps: one record for each run, from line `first` on.

    A line that isn't a link, or has a code without a rank, is raw; one longer than LONGEST_LINE bytes is an error."""
    known = parsed(lines).join(ranked, ["doc", "code"], "left")
    w = Window.partitionBy("doc").orderBy("line_no")
    same = F.col("rank").isNotNull() & F.lag("rank").over(w).isNotNull() & (F.lag("title").over(w) == F.col("title")) & (F.lag("suffix").over(w) == F.col("suffix"))
    runs = known.withColumn("_new", F.when(same, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = runs.groupBy("doc", "_run").agg(
        F.min("line_no").alias("first"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("line_no", "rank"))).alias("ids"),
        *[F.first(c).alias(c) for c in ("title", "suffix", "line")],
    )
    code = lambda k: F.lit(bytes([k]))
    ids = F.unhex(F.array_join(F.transform("ids", lambda x: F.lpad(F.hex(x["rank"]), 2, "0")), ""))
    size, title, suffix, end = F.octet_length("line"), F.col("title").cast("binary"), F.col("suffix").cast("binary"), code(10)
    has, many = F.col("suffix") != "", F.col("n") > 1
    raw = F.when(size <= LONGEST_LINE, F.concat(code(RAW), to_le(size, 2), F.col("line").cast("binary"))).otherwise(F.raise_error(F.lit("a line is too long")).cast("binary"))
    op = F.when(F.col("ids")[0]["rank"].isNull(), raw).when(many & has, F.concat(code(RUN_WITH_SUFFIX), uvarint(F.col("n")), ids, title, code(0), suffix, end))
    op = op.when(many, F.concat(code(RUN), uvarint(F.col("n")), ids, title, end)).when(has, F.concat(code(WITH_SUFFIX), ids, title, code(0), suffix, end))
    return rows.select("doc", "first", op.otherwise(F.concat(ids, title, end)).alias("op"))


def expanded(ops: DataFrame, ranked: DataFrame) -> DataFrame:
    """(doc, line_no, line): the inverse of packed()."""
    kind, op = F.col("kind"), F.col("op")
    known = ops.withColumn("kind", byte_at(op, 1))
    run = kind.isin(RUN, RUN_WITH_SUFFIX)
    count = F.unhex(F.regexp_extract(F.hex(F.substring("op", 2, 9)), r"^((?:[89A-F][0-9A-F])*[0-7][0-9A-F])", 1))
    known = known.withColumns({"n": F.when(run, from_uvarint(count)).otherwise(1), "at": F.when(run, 2 + F.octet_length(count)).when(kind == WITH_SUFFIX, 2).otherwise(1)})
    raw = known.where(kind == RAW).select("doc", F.col("first").alias("line_no"), F.decode(F.substr(op, F.lit(4)), "UTF-8").alias("line"))
    after = F.decode(F.substring(op, F.col("at") + F.col("n").cast("int"), F.octet_length(op) - F.col("at") - F.col("n").cast("int")), "UTF-8")
    links = known.where(kind != RAW).withColumn("rest", F.split(after, "\x00"))
    spread = links.select("doc", "first", "rest", "op", "at", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("k"))
    spread = spread.select("doc", (F.col("first") + F.col("k")).alias("line_no"), "rest", byte_at(op, F.col("at") + F.col("k")).cast("int").alias("rank")).join(ranked, ["doc", "rank"])
    line = F.concat(F.lit("["), "code", F.lit(":"), F.get("rest", F.lit(0)), F.lit("]"), F.coalesce(F.get("rest", F.lit(1)), F.lit("")))
    return raw.unionByName(spread.select("doc", "line_no", line.alias("line")))
