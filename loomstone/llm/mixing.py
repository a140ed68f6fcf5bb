"""Mixing sources to target weights, with DataFrame and SQL functions only.

Each source's words, in doc_id order, are packed into blocks of a fixed length (a shorter one for a source
of few words, so that whole blocks come near its target). Every output shard draws a multinomial count of slots for each source; a source's slots, numbered over all
shards, go through a pseudorandom permutation of its block indices, as often as the target
asks; and slots and documents are joined by block index.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.llm.prefix import prefix_sums
from loomstone.llm.runtime import materialise, partitions

#: Words of a block; a source has so many blocks at least, if it has as many words.
BLOCK_WORDS, LEAST_BLOCKS, SHARD_SLOTS, ROUNDS = 128, 256, 1024, 8
#: Slots that a partition of the draws makes.
SLOTS_PER_PART = 1_000_000
KEY = ["no_source", "source_key"]
_SPACES = " \t\n\x0b\x0c\r"


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Adds target to rows (no_source, source_key, source_size): share of all sizes, split by weights.

    Weights repeat over the sources by code point, null last. No target exceeds most times its
    source's size. A row for each source, and nothing else, goes through one task: with sources in order of cap / weight, the common rate
    is that of the first source that isn't cut, the largest of those that cut nothing more.
    """
    total = Window.partitionBy()
    ranked = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(Window.orderBy(*KEY)) - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("cap", most * F.col("source_size"))
    before = Window.orderBy(F.col("cap") / F.col("weight"), *KEY).rowsBetween(Window.unboundedPreceding, -1)
    rest = ranked.withColumns({"all_size": F.sum("source_size").over(total), "all_weight": F.sum("weight").over(total), "cut": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "cut_weight": F.coalesce(F.sum("weight").over(before), F.lit(0.0))})
    rate = rest.withColumn("rate", (share * F.col("all_size") - F.col("cut")) / (F.col("all_weight") - F.col("cut_weight")))
    rate = rate.withColumn("common", F.max(F.when(F.col("rate") * F.col("weight") <= F.col("cap"), F.col("rate"))).over(total))
    return rate.select(*KEY, "source_size", F.coalesce(F.least(F.col("cap"), F.col("common") * F.col("weight")), F.col("cap")).alias("target"))


def permuted(index: Column, n: Column, *seed: Column) -> Column:
    """A pseudorandom permutation of 0 .. n - 1 at index: swap-or-not rounds, each its own inverse."""

    def swap(x: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(*seed, F.lit("key"), r), n) - x, n)
        return F.when(F.pmod(F.xxhash64(*seed, r, F.greatest(x, partner)), F.lit(2)) == 0, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index, swap)


def _slots(targets: DataFrame, seed: int) -> DataFrame:
    """(shard, no_source, source_key, slot): each source's slots 0 .. n_slots - 1, each in one shard.

    A shard's slots draw their sources by weight, which makes its counts multinomial. Over all
    shards a source may have drawn more than its number of slots: what is over goes, in order,
    to the sources that drew too few, so that totals are met exactly. Slots are made in parallel, and
    sums over shards are prefix sums over range partitions; the driver has the number of slots alone.
    """
    spark = targets.sparkSession
    bounds = targets.where("n_slots > 0").withColumn("high", F.sum("n_slots").over(Window.orderBy(*KEY))).withColumn("low", F.col("high") - F.col("n_slots"))
    slots = bounds.agg(F.coalesce(F.max("high"), F.lit(0))).first()[0]
    parts = partitions(spark, slots, SLOTS_PER_PART)
    drawn = spark.range(0, slots, 1, parts).select(F.floor(F.col("id") / SHARD_SLOTS).alias("shard"), F.pmod("id", F.lit(SHARD_SLOTS)).alias("place"))
    drawn = drawn.withColumn("at", F.pmod(F.xxhash64(F.lit(seed), "shard", "place"), F.lit(max(1, slots))))
    # Draws and sources meet by intervals of equal width. Spark takes what explode() makes for small and would
    # broadcast the draws, which grow with the data; so the join is told to shuffle.
    width = F.lit(max(1, slots // max(256, 4 * parts)))
    near = bounds.withColumn("bin", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width))))
    counts = (
        drawn.withColumn("bin", F.floor(F.col("at") / width))
        .join(near.select("bin", "low", "high", "n_slots", *KEY).hint("shuffle_hash"), "bin")
        .where("at >= low and at < high")
        .groupBy("shard", *KEY)
        .agg(F.count("*").alias("c"), F.first("n_slots").alias("n_slots"))
    )
    counts = prefix_sums(counts, KEY, [F.col("shard")], {"start": F.col("c")}, "mix-counts")
    counts = materialise(counts.withColumn("kept", F.greatest(F.lit(0), F.least("c", F.col("n_slots") - F.col("start")))), "mix-draws")
    # Few rows become many slots here: they are dealt out first, to as many tasks as the slots ask for.
    own = counts.where("kept > 0").repartition(parts, "shard").select("shard", *KEY, F.explode(F.sequence(F.col("start"), F.col("start") + F.col("kept") - 1)).alias("slot"))
    over = counts.groupBy("shard").agg(F.sum(F.col("c") - F.col("kept")).alias("n")).where("n > 0")
    over = prefix_sums(over, [], [F.col("shard")], {"from": F.col("n")}, "mix-over").select("shard", F.explode(F.sequence(F.col("from"), F.col("from") + F.col("n") - 1)).alias("rank"))
    short = targets.join(counts.groupBy(*KEY).agg(F.sum("c").alias("drawn")), KEY, "left").withColumn("n", F.col("n_slots") - F.coalesce("drawn", F.lit(0))).where("n > 0")
    short = prefix_sums(short, [], [F.col(c) for c in KEY], {"from": F.col("n")}, "mix-short")
    short = short.select(*KEY, "n_slots", "n", "from", F.explode(F.sequence(F.col("from"), F.col("from") + F.col("n") - 1)).alias("rank"))
    moved = over.join(short.hint("shuffle_hash"), "rank").select("shard", *KEY, (F.col("n_slots") - F.col("n") + F.col("rank") - F.col("from")).alias("slot"))
    return own.unionByName(moved)


def _plan(docs: DataFrame, seed: int, carry: Sequence[Column] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with size, words before them in their source and the words of its blocks; targets of sources; uses of blocks."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").isNull().cast("int").alias("no_source"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source_key"),
        F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_hash"),
        *carry,
    )
    placed = materialise(prefix_sums(rows, KEY, [F.col("doc_id").asc_nulls_last(), F.col("text_hash")], {"before": F.col("size")}, "mix-rows"), "mix-placed")
    targets = source_targets(placed.groupBy(*KEY).agg(F.sum("size").alias("source_size")))
    targets = targets.withColumn("block_words", F.greatest(F.lit(1), F.least(F.lit(BLOCK_WORDS), F.floor(F.col("source_size") / LEAST_BLOCKS))))
    targets = targets.withColumn("n_blocks", F.ceil(F.col("source_size") / F.col("block_words")))
    targets = targets.withColumn("n_slots", F.coalesce(F.least(F.round(F.try_divide("target", "source_size") * F.col("n_blocks")).cast("long"), 2 * F.col("n_blocks")), F.lit(0)))
    targets = materialise(targets, "mix-targets")
    slots = _slots(targets.select(*KEY, "n_slots"), seed).join(targets.select(*KEY, "n_blocks"), KEY)
    block = permuted(F.pmod("slot", "n_blocks"), F.col("n_blocks"), F.lit(seed), F.col("no_source"), F.col("source_key"))
    uses = slots.select(*KEY, block.alias("block")).groupBy(*KEY, "block").agg(F.count("*").alias("uses"))
    return placed.join(targets.select(*KEY, "block_words"), KEY), targets, uses


def _pieces(placed: DataFrame, uses: DataFrame, how: str = "inner") -> DataFrame:
    """One row for each document and block that it has words in, with the block's uses."""
    words = F.col("block_words")
    first, last = F.floor(F.col("before") / words), F.floor((F.col("before") + F.col("size") - 1) / words)
    spread = placed.where("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    low = F.greatest(F.col("before"), F.col("block") * words)
    high = F.least(F.col("before") + F.col("size"), (F.col("block") + 1) * words)
    return spread.select("doc_id", *KEY, "text_hash", "before", "size", "block", (low - F.col("before")).alias("at"), (high - low).alias("n")).join(uses, [*KEY, "block"], how)


def mix(docs: DataFrame, seed: int = 17) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of docs.

    size: words of the text (null or empty: 0). Nulls in source are a source of their own, the
    last. A source without words has target 0. Further columns are ignored, whatever their names. taken counts words of the row in the mix, repeats
    included; a block is used twice at most, so taken is at most twice the size. Everything follows from the rows and the seed,
    so reruns agree. Rows that repeat a doc_id are rows of their own; an empty table gives none.
    """
    placed, targets, uses = _plan(docs, seed)
    counted = _pieces(placed, uses, "left").groupBy("doc_id", *KEY, "text_hash", "before", "size")
    joined = counted.agg(F.sum(F.col("n") * F.coalesce("uses", F.lit(0))).alias("taken")).select("doc_id", *KEY, "size", "taken")
    empty = placed.where("size = 0").select("doc_id", *KEY, "size", F.lit(0).cast("long").alias("taken"))
    return joined.unionByName(empty).join(targets.drop("block_words"), KEY).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The mix as documents: of each row, one text of the words taken once at least and, if some
    are taken twice, a second one of those. A whole text stays as it is; parts of one are its
    words joined by a space. Columns are those of docs; n_chars, if there is one, is counted anew.
    """
    placed, _, uses = _plan(docs, seed)
    pieces = _pieces(placed, uses).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("uses").cast("int"))))
    parts = pieces.groupBy("doc_id", *KEY, "text_hash", "before", "size", "copy").agg(F.array_sort(F.collect_list(F.struct("at", "n"))).alias("parts"), F.sum("n").alias("n_taken"))
    # The caller's columns travel in a struct, so that none can clash with those made here.
    own = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_doc"), F.col("source").isNull().cast("int").alias("_null"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_key"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("_hash"))
    # Rows equal in all of these have the same text: one of them serves the pieces of all.
    own = own.dropDuplicates(["_doc", "_null", "_key", "_hash"])
    joined = own.join(parts, F.col("_doc").eqNullSafe(F.col("doc_id")) & (F.col("_null") == F.col("no_source")) & (F.col("_key") == F.col("source_key")) & (F.col("_hash") == F.col("text_hash")))
    words = F.split(F.btrim(F.col("_row.text"), F.lit(_SPACES)), r"[\x20\x09-\x0D]+")
    joined = joined.withColumn("_words", F.when(F.col("n_taken") < F.col("size"), words))
    some = F.array_join(F.flatten(F.transform("parts", lambda p: F.slice(F.col("_words"), (p["at"] + 1).cast("int"), p["n"].cast("int")))), " ")
    joined = joined.withColumn("_text", F.when(F.col("n_taken") == F.col("size"), F.col("_row.text")).otherwise(some))
    new = {"text": F.col("_text"), "n_chars": F.char_length("_text")}
    return joined.select(*[new.get(c, F.col(f"_row.`{c}`")).cast(t).alias(c) for c, t in docs.dtypes])
