"""Typed records of header lines, and dictionaries of what repeats in them.

Lines are (doc, line_no, line). What a number means depends on the line before it, so that each doc's lines are
windowed by line_no; docs are independent of each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.functions.binary import byte_at, from_le, from_uvarint, to_le
from loomstone.functions.scalar import ipv4, unzigzag, uvarint, zigzag

#: Fixed values of the format: a byte for each kind of record, the dictionary's mark, and its entries at most.
REVISION, CONTRIBUTOR, END_CONTRIBUTOR, POSITION, ID, TIME, USER, USER_LITERAL, IP, RAW, ID_DELTA, USER_ID = range(1, 13)
MARK, ENTRIES, LONGEST_NAME, LONGEST_LINE = "M3H2", 255, 255, 65535


def classified(lines: DataFrame) -> DataFrame:
    """Adds kind. Numbers and addresses that wouldn't be written the same way again (leading zeros, say) are raw."""
    line = F.col("line")
    time = r"^timestamp>[0-9]{2}(0|[1-9][0-9]{0,3}):(0|[1-9][0-9]{0,8})$"
    address = F.when(line.startswith("ip>") & ~line.rlike(r"[>.]0[0-9]"), ipv4(F.substring(line, 4, 20)))
    kind = F.when(line == "revision>", "revision").when(line == "contributor>", "contributor").when(line == "/contributor>", "end")
    kind = kind.when(line.rlike(r"^>(0|-?[1-9][0-9]{0,17})$"), "position").when(line.rlike(r"^id>(0|[1-9][0-9]{0,17})$"), "id").when(line.rlike(time), "time")
    return lines.withColumn("kind", kind.when(line.startswith("username>"), "user").when(address.isNotNull(), "ip").otherwise("raw"))


def counted_ids(lines: DataFrame) -> DataFrame:
    """(doc, line_no, id): ids that follow a user, by a state that lines of no known kind leave as it is."""
    line = F.col("line")
    state = F.when(F.col("kind") == "revision", 1).when(F.col("kind") == "user", 2)
    state = state.when(F.col("kind").isin("id", "contributor", "end") | line.startswith("ip>") | line.startswith(">"), 0)
    before = Window.partitionBy("doc").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    seen = lines.withColumn("state", F.last(state, ignorenulls=True).over(before))
    return seen.where("kind = 'id' and state = 2").select("doc", "line_no", F.substring("line", 4, 18).cast("long").alias("id"))


def _ranked(items: DataFrame, key: str) -> DataFrame:
    """(doc, key, rank): of each doc the keys that occur twice or more, by count, then by where they were first seen."""
    counted = items.groupBy("doc", key).agg(F.count("*").alias("n"), F.min("line_no").alias("seen")).where("n >= 2")
    rank = F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("n"), "seen")) - 1
    return counted.withColumn("rank", rank).where(F.col("rank") < ENTRIES).select("doc", key, "rank")


def dictionaries(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc, name, rank) of users and (doc, id, rank) of their ids. Names longer than a literal may be aren't entries."""
    known = classified(lines)
    name = F.substr(F.col("line"), F.lit(10))
    users = known.where("kind = 'user'").select("doc", "line_no", name.alias("name")).where(F.octet_length("name") <= LONGEST_NAME)
    return _ranked(users, "name"), _ranked(counted_ids(known), "id")


def encoded(lines: DataFrame, users: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc, line_no, op): each line as one record; a raw line longer than LONGEST_LINE bytes is an error."""
    w = Window.partitionBy("doc").orderBy("line_no")
    kind, line = F.col("kind"), F.col("line")
    known = classified(lines).withColumns({
        "after": F.lag(kind).over(w),
        "id": F.when(kind == "id", F.substring(line, 4, 18).cast("long")),
        "name": F.when(kind == "user", F.substr(line, F.lit(10))),
    })
    revision = (kind == "id") & (F.col("after") == "revision")
    known = known.withColumn("last", F.last(F.when(revision, F.col("id")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    known = known.join(users.withColumnRenamed("rank", "user_rank"), ["doc", "name"], "left").join(ids.withColumnRenamed("rank", "id_rank"), ["doc", "id"], "left")
    code = lambda n: F.lit(bytes([n]))
    size, raw = F.octet_length(line), line.cast("binary")
    as_raw = F.when(size <= LONGEST_LINE, F.concat(code(RAW), to_le(size, 2), raw)).otherwise(F.raise_error(F.lit("a line is too long")).cast("binary"))
    part = lambda k: F.regexp_extract(line, r"^timestamp>([0-9]{2})([0-9]+):([0-9]+)$", k).try_cast("long")
    octets = F.split(F.substring(line, 4, 20), r"\.")
    of_id = F.when(revision & F.col("last").isNotNull(), F.concat(code(ID_DELTA), uvarint(zigzag(F.col("id") - F.col("last")))))
    of_id = of_id.when((F.col("after") == "user") & F.col("id_rank").isNotNull(), F.concat(code(USER_ID), to_le(F.col("id_rank"), 1))).otherwise(F.concat(code(ID), uvarint(F.col("id"))))
    name_size = F.octet_length("name")
    of_user = F.when(F.col("user_rank").isNotNull(), F.concat(code(USER), to_le(F.col("user_rank"), 1)))
    of_user = of_user.when(name_size <= LONGEST_NAME, F.concat(code(USER_LITERAL), to_le(name_size, 1), F.col("name").cast("binary"))).otherwise(as_raw)
    op = F.when(kind == "revision", code(REVISION)).when(kind == "contributor", code(CONTRIBUTOR)).when(kind == "end", code(END_CONTRIBUTOR))
    op = op.when(kind == "position", F.concat(code(POSITION), uvarint(zigzag(F.substring(line, 2, 20).try_cast("long"))))).when(kind == "id", of_id)
    op = op.when(kind == "time", F.concat(code(TIME), to_le(part(1), 1), to_le(part(2), 2), to_le(part(3), 4))).when(kind == "user", of_user)
    op = op.when(kind == "ip", F.concat(code(IP), *[to_le(F.get(octets, k).try_cast("int"), 1) for k in range(4)])).otherwise(as_raw)
    return known.select("doc", "line_no", op.alias("op"))


def expanded(ops: DataFrame, users: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc, line_no, line): the inverse of encoded(). Ids of revisions are running sums of their deltas."""
    w = Window.partitionBy("doc").orderBy("line_no")
    code, op, rest = F.col("code"), F.col("op"), F.substr(F.col("op"), F.lit(2))
    known = ops.withColumn("code", byte_at(op, 1))
    number = F.when(code.isin(POSITION, ID, ID_DELTA), from_uvarint(F.when(code.isin(POSITION, ID, ID_DELTA), rest)))
    known = known.withColumns({"number": number, "rank": F.when(code.isin(USER, USER_ID), byte_at(op, 2).cast("int")), "after": F.lag(code).over(w)})
    step = F.when((code == ID) & (F.col("after") == REVISION), F.col("number")).when(code == ID_DELTA, unzigzag(F.col("number")))
    known = known.withColumn("id_now", F.sum(step).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    known = known.join(users.select("doc", "rank", F.lit(USER).cast("long").alias("code"), "name"), ["doc", "rank", "code"], "left")
    known = known.join(ids.select("doc", "rank", F.lit(USER_ID).cast("long").alias("code"), F.col("id").alias("user_id")), ["doc", "rank", "code"], "left")
    text = lambda at: F.decode(F.substr(op, F.lit(at)), "UTF-8")
    time = F.concat(F.lit("timestamp>"), F.lpad(byte_at(op, 2).cast("string"), 2, "0"), from_le(op, 3, 2).cast("string"), F.lit(":"), from_le(op, 5, 4).cast("string"))
    line = F.when(code == REVISION, "revision>").when(code == CONTRIBUTOR, "contributor>").when(code == END_CONTRIBUTOR, "/contributor>")
    line = line.when(code == POSITION, F.concat(F.lit(">"), unzigzag(F.col("number")).cast("string"))).when(code == ID, F.concat(F.lit("id>"), F.col("number").cast("string")))
    line = line.when(code == ID_DELTA, F.concat(F.lit("id>"), F.col("id_now").cast("string"))).when(code == USER_ID, F.concat(F.lit("id>"), F.col("user_id").cast("string")))
    line = line.when(code == TIME, time).when(code == USER, F.concat(F.lit("username>"), F.col("name"))).when(code == USER_LITERAL, F.concat(F.lit("username>"), text(3)))
    line = line.when(code == IP, F.concat(F.lit("ip>"), F.concat_ws(".", *[byte_at(op, k).cast("string") for k in range(2, 6)]))).when(code == RAW, text(4))
    return known.select("doc", "line_no", line.alias("line"))


def side_dictionary(docs: DataFrame, users: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc, side): each doc's two dictionaries as bytes, names with their lengths, ids as varints; at most ENTRIES of each."""

    def listed(entries: DataFrame, name: str, part: Column) -> DataFrame:
        rows = entries.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("rank", F.hex(part).alias("part")))).alias("p"))
        return rows.select("doc", F.concat(F.hex(to_le(F.size("p"), 1)), F.array_join(F.transform("p", lambda x: x["part"]), "")).alias(name))

    names = listed(users, "names", F.concat(to_le(F.octet_length("name"), 1), F.col("name").cast("binary")))
    numbers = listed(ids, "numbers", uvarint(F.col("id")))
    joined = docs.select("doc").distinct().join(names, "doc", "left").join(numbers, "doc", "left")
    none = F.lit("00")
    return joined.select("doc", F.concat(F.lit(MARK.encode()), F.unhex(F.concat(F.coalesce("names", none), F.coalesce("numbers", none)))).alias("side"))
