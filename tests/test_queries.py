import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from loomstone.functions import hashing
from loomstone.plans import catalogue, similarity
from loomstone.streaming import segments

from compare import in_duckdb, rows


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, folder, name):
    found = catalogue.QUERIES[name](spark, folder).toPandas()
    if name in catalogue.ORACLES:
        expected = in_duckdb(catalogue.ORACLES[name], folder)
        assert sorted(found.columns) == sorted(expected.columns)
        columns = sorted(found.columns)
        assert rows(found, columns) == rows(expected, columns)
    else:
        assert len(found)


def test_entry(spark):
    assert entry.entry(spark).count() == 255
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_coded_segments_round_trip(spark, folder):
    found = catalogue.QUERIES["q_range_coder"](spark, folder).toPandas()
    assert found["ok"].all() and found["small"].mean() > 0.9


def test_stream_of_many_unordered_files(spark, folder, tmp_path):
    """More part files than a few, written from the last event_id to the first, some ids negative, some values null."""
    events = spark.read.parquet(f"{folder}/events.parquet").withColumn("event_id", F.col("event_id") - 100)
    events = events.withColumn("value", F.when((F.col("user_id") % 3 > 0) & (F.col("event_id") % 7 > 0), F.col("value")))
    events.repartitionByRange(12, F.desc("event_id")).write.parquet(f"{tmp_path}/events.parquet")
    found = catalogue.QUERIES["q_segments_stream"](spark, str(tmp_path)).toPandas()
    expected = catalogue.QUERIES["q_segments"](spark, str(tmp_path)).toPandas()
    assert len(expected)
    assert rows(found, sorted(expected.columns)) == rows(expected, sorted(expected.columns))


def test_stream_refuses_late_events():
    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    state = State()
    frame = lambda ids: iter([pd.DataFrame({"event_id": ids, "cents": [1] * len(ids)})])
    made = pd.concat(segments._update((7,), frame([*range(20, 3, -1), 40]), state))
    assert made.values.tolist() == [[7, 0, 16, 16, 19]]
    with pytest.raises(ValueError, match="event 3 came after"):
        list(segments._update((7,), frame([3, 50]), state))


def test_recent_choice_next_to_ties(spark, tmp_path):
    """A short text for each segment: every other mean of two rates is half a millionth, give or take what binary can't hold."""
    draw = random.Random(5)
    docs = [(100 * i, "".join(draw.choices("abcdefgh", range(1, 9), k=draw.randrange(5, 60))), "en") for i in range(400)]
    pd.DataFrame(docs, columns=["doc_id", "text", "lang"]).to_parquet(f"{tmp_path}/documents.parquet")
    found, expected = catalogue.QUERIES["q_recent_choice"](spark, str(tmp_path)).toPandas(), in_duckdb(catalogue.ORACLES["q_recent_choice"], str(tmp_path))
    assert rows(found, sorted(expected.columns)) == rows(expected, sorted(expected.columns))


def test_near_pairs_among_hashes_alike(spark):
    """Hashes alike in their first 16 bits, some near others: all pairs, each once, and few that had to be looked at."""
    draw = random.Random(3)
    near = lambda h, n: h ^ sum(1 << b for b in draw.sample(range(64), n))
    some = [0xABCD << 48 | draw.getrandbits(48) for _ in range(1500)]
    hashes = sorted({*some, *(near(h, 1 + i % 4) for i, h in enumerate(some[:400])), 0, (1 << 64) - 1})
    x = spark.createDataFrame([(i, h - (1 << 63)) for i, h in enumerate(hashes)], "id long, h long")
    expected = sorted((i, j, (g ^ h).bit_count()) for i, g in enumerate(hashes) for j, h in enumerate(hashes[i + 1 :], i + 1) if (g ^ h).bit_count() <= 3)
    assert sorted(map(tuple, similarity.near_pairs(x, 3).collect())) == expected
    masks = [m % (1 << 64) for m in similarity._masks(3)]
    assert len(masks) == 20
    assert sum(n * n for m in masks for n in Counter(h & m for h in hashes).values()) < 30 * len(hashes)


def test_simhash_votes_over_many_pieces():
    """Votes of long and short blocks side by side are those of each gram one by one."""
    draw = random.Random(8)
    blocks = [bytes(draw.choices(b"abc\xff", k=n)) for n in (0, 1, 2, 3, 4, 16, 17, 257, 258, 269, 270, 1500, 0)]
    for block, found in zip(blocks, hashing.simhashes(blocks).tolist(), strict=True):
        body = block[12:] if len(block) > 16 else block
        grams = [int.from_bytes(body[i : i + 3], "big") * hashing.GOLDEN % (1 << 64) for i in range(len(body) - 2)] if len(body) > 2 else list(body)
        z = [int(v) for g in grams for v in hashing.splitmix([g])]
        assert found == sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in z) > len(z))


@pytest.mark.parametrize("name", ["q_first_merge", "q_word_codes", "q_dict_top255", "q_dict_encode_len"])
def test_words_and_pairs_are_not_sorted(spark, folder, name, capsys):
    """Aggregates over every pair or word keep one number for each key; structs would sort all of them and spill. Pieces of texts aren't shuffled."""
    catalogue.QUERIES[name](spark, folder).explain()
    plan = capsys.readouterr().out
    assert "HashAggregate" in plan
    assert "SortAggregate" not in plan and "piece" not in plan
