"""Null columns, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from loomstone.llm import bpe, fingerprint, jaccard, line_dedup, mixing, neighbours, quality, sharding, token_files, toxicity

LONG = "x" * 120_000
LINE = "A shared line of more than twenty characters"
ROWS = [
    (1, None, "en", "a", 0),
    (2, "", "en", "a", 0),
    (3, " \t\n ", None, None, 4),
    (4, "one two three four five six seven", "en", "a", 33),
    (4, "one two three four five six seven", "en", "a", 33),
    (5, "One TWO three four five six seven", "en", "b", 33),
    (6, LONG, "en", "b", len(LONG)),
    (7, LINE + "\nfirst", "en", "b", None),
    (8, LINE.lower() + " \nsecond", "en", None, None),
    (9, LINE + "\n" + LINE, "de", "c", None),
    (None, LINE + "\nno id", None, "c", None),
    (10, "word " * 3000, "fr", "c", None),
    (11, "é ünïcödé ñ 你好 <|endoftext|> ﬁ İ ß", "fr", "c", None),
    (-5, "a", "fr", "c", None),
]
CLASHES = ["id", "key", "ids", "n_dropped", "n_lines", "shard", "before", "copy", "uses", "hash", "node", "size", "_part", "at", "score", "k"]


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    return frame.withColumns({c: F.lit(f"mine {c}") for c in CLASHES}).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (5, 0, 1), (5, 0, 1), (7, 1, 0), (8, None, None), (None, 1, 1), (10, 0, 0), (999, 1, 1)], "doc_id long, quality int, toxic int")


def texts():
    return sorted(((i, t or "") for i, t, *_ in ROWS), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))


def test_classifiers(docs, labels):
    for module in (quality, toxicity):
        out = module.classify(docs, labels).toPandas()
        assert len(out) == len(ROWS)
        assert out["score"].between(0, 1).all()
        assert set(out["predicted"]) <= {0, 1}
        held = {i: bool(zlib.crc32(str(i).encode()) % 5 == 0) for i, *_ in ROWS if i is not None}
        assert all(held[i] == h for i, h in zip(out["doc_id"], out["held_out"], strict=True) if i == i)
        nothing = module.classify(docs, labels.limit(0)).toPandas()
        assert (nothing["score"] == 0.5).all()
        assert module.classify(docs.limit(0), labels).count() == 0


def test_near_duplicates(docs):
    out = jaccard.near_duplicates(docs)
    assert out.count() == len(ROWS)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect() if r.doc_id is not None}
    assert found[1] == (0, 1) and found[2] == (0, 2) and found[3] == (0, 3)
    assert found[4] == (3, 4) and found[5] == (3, 4)
    assert found[6] == (1, 6) and found[10] == (1, 10) and found[-5] == (1, -5)
    assert jaccard.near_duplicates(docs.limit(0)).count() == 0


def test_bpe(docs):
    out = bpe.encode(docs, chunk=1000, overlap=100).withColumn("raw", bpe.decode(F.col("ids"))).collect()
    own = bpe.encoding(*bpe.defaults())
    assert len(out) == len(ROWS)
    for r in out:
        assert r.ids == own.encode_ordinary(r.text or "")
        assert bytes(r.raw) == (r.text or "").encode()
        assert r.key == "mine key"
    assert bpe.digest(docs.limit(0)).count() == 0


def check_order(out, rows):
    """Documents by descending id, null last, then by the text's hash and the text: each one's edited text shows its follower."""
    signed = lambda t: (x := xxhash.xxh64_intdigest(t.encode(), 42)) - (x >> 63 << 64)
    ranked = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0), signed(x[1]), x[1]))
    made = Counter((i, len(t), hashlib.sha256(fingerprint.edited(t, ranked[(k + 1) % len(ranked)][1]).encode()).hexdigest()) for k, (i, t) in enumerate(ranked))
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in out) == made
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)


def test_fingerprints_of_hot_ids(spark):
    """A null id and one more with many texts each are spread over blocks, and the order holds across them."""
    rows = [(None, f"text of nobody {i} " * 5) for i in range(150)] + [(7, f"seven {i} " * 5) for i in range(150)] + [(i, f"single {i}") for i in range(40)] + [(7, "same")] * 5
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    check_order(fingerprint.compare(frame).collect(), rows)
    blocks = [r.c for r in fingerprint.in_order(frame).groupBy("block").agg(F.count("*").alias("c")).collect()]
    assert len(blocks) > 3 and max(blocks) < 200


def test_line_dedup_of_hot_ids(spark):
    """Rows without an id are one document, each cut by itself."""
    rows = [(None, f"{LINE}\n{LINE} again {i % 3}\nonly {i}") for i in range(60)] + [(i, f"{LINE}\n{LINE} again {i}") for i in range(3)]
    out = line_dedup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.text for r in out if r.doc_id is None) == sorted(f"{LINE} again {i % 3}\nonly {i}" for i in range(60))
    assert {r.doc_id: r.text for r in out if r.doc_id is not None} == {0: f"{LINE} again 0", 1: f"{LINE} again 1", 2: f"{LINE}\n{LINE} again 2"}


def test_fingerprints(docs):
    out = fingerprint.compare(docs).collect()
    assert len(out) == len(ROWS)
    check_order(out, [(i, t or "") for i, t, *_ in ROWS])
    single = fingerprint.compare(docs.where("doc_id = 6")).collect()
    assert single[0].near_next == 1
    assert fingerprint.compare(docs.limit(0)).count() == 0


def test_line_dedup(docs):
    out = {r.doc_id: r for r in line_dedup.drop_repeated_lines(docs).collect()}
    assert out[1].text == "" and (out[1].n_lines, out[1].n_dropped) == (1, 0)
    assert out[7].text == "first" and out[8].text == "second" and out[None].text == "no id"
    assert out[9].text == LINE + "\n" + LINE and out[9].n_dropped == 0
    assert out[3].n_lines == 2 and out[3].key == "mine key"
    assert line_dedup.drop_repeated_lines(docs.limit(0)).count() == 0
    assert line_dedup.drop_repeated_lines(docs).count() == len(ROWS)


def test_token_files(docs):
    out = token_files.digest(docs).orderBy("start").collect()
    own = token_files._tokenizer(token_files.default_path())
    start = 0
    for r, (i, t) in zip(out, texts(), strict=True):
        ids = own.encode(t, add_special_tokens=False).ids + [2]
        crc = zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), crc)
        start += len(ids)
    assert token_files.digest(docs.limit(0)).count() == 0


def test_sharding(docs):
    out = sharding.shard(docs).collect()
    assert len(out) == len(ROWS)
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r)
    assert all(sorted(r.slot for r in rows) == list(range(len(rows))) for rows in by.values())
    assert sum(r.size for r in out) == sum(len((t or "").encode()) + 1 for _, t, *_ in ROWS)
    assert {r.law for r in out} == {"bytes"}
    assert sharding.shard(docs.limit(0)).count() == 0


def test_mixing(docs):
    out = mixing.mix(docs).collect()
    assert len(out) == len(ROWS)
    assert all(r.taken <= 2 * r.size for r in out)
    assert sorted(r.size for r in out) == sorted(len((t or "").split()) for _, t, *_ in ROWS)
    total = {}
    for r in out:
        total.setdefault((r.source_size, r.target), 0)
        total[r.source_size, r.target] += r.taken
    assert all(abs(taken - target) <= max(1, size / mixing.LEAST_BLOCKS) for (size, target), taken in total.items())
    assert sorted(map(tuple, mixing.mix(docs).collect()), key=str) == sorted(map(tuple, out), key=str)
    texts_out = mixing.mixed_documents(docs)
    assert texts_out.columns == docs.columns
    assert texts_out.select(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0] == sum(r.taken for r in out)
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed_documents(docs.limit(0)).count() == 0


def test_mixing_source_without_words(spark):
    kept = [(i, "one two three", "a") for i in range(300)]
    none = [(1000, None, "b"), (1001, "", "b"), (1002, " \t\n", "b"), (1003, None, None)]
    schema = "doc_id long, text string, source string"
    docs = spark.createDataFrame(kept + none, schema)
    out = {r.doc_id: r for r in mixing.mix(docs).collect()}
    assert len(out) == len(kept + none)
    assert all((out[i].size, out[i].source_size, out[i].target, out[i].taken) == (0, 0, 0, 0) for i, *_ in none)
    assert abs(sum(out[i].taken for i, *_ in kept) - 1.5 * 900) <= mixing.BLOCK_WORDS
    assert {r.source for r in mixing.mixed_documents(docs).collect()} == {"a"}
    empty = spark.createDataFrame(none, schema)
    assert [r.taken for r in mixing.mix(empty).collect()] == [0] * 4 and mixing.mixed_documents(empty).count() == 0


def test_neighbours(spark):
    same = [1.0, 2.0, 3.0]
    rows = [(i, same) for i in range(0, 200, 10)] + [(1, None), (None, same), (100000, [0.0, 0.0, 0.0]), (50050, [1.0, None, 2.0]), (3, [float("nan"), 1.0, 1.0]), (4, [float("inf"), 1.0, 1.0]), (5, [1.0, 0.0]), (7, [-1.0, 0.5, 0.25]), (7, [-1.0, 0.5, 0.25]), (8, [])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("key", F.lit("mine")).withColumn("rank", F.lit("mine"))
    out = neighbours.search_fiftieths(vectors).orderBy("query_id", "rank").collect()
    assert [r.query_id for r in out] == [q for q in (0, 50, 100, 150) for _ in range(5)]
    assert [r.vec_id for r in out if r.query_id == 0] == [10, 20, 30, 40, 50]
    assert [r.vec_id for r in out if r.query_id == 50] == [0, 10, 20, 30, 40]
    assert neighbours.search_fiftieths(vectors.limit(0)).count() == 0
    few = neighbours.search_fiftieths(vectors.where("vec_id in (0, 7)")).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in few] == [(0, 1, 7)]
    assert neighbours.search_fiftieths(vectors.where("vec_id = 0")).count() == 0


def test_neighbours_of_each_length(spark):
    rows = [(i, [float(i), 1.0, 2.0]) for i in range(0, 300, 10)] + [(i + 5, [1.0, i + 1.0]) for i in range(0, 200, 10)] + [(1000, [1.0, 5.0]), (1050, [1.0] * 4)]
    out = neighbours.search_fiftieths(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    size = {i: len(v) for i, v in rows}
    assert sorted((r.query_id, r.rank) for r in out) == [(q, k) for q in (0, 50, 100, 150, 200, 250, 1000) for k in range(1, 6)]
    assert all(size[r.query_id] == size[r.vec_id] and r.query_id != r.vec_id for r in out)
    cosine = {i: (1 + 5 * v[1]) / (26 * (1 + v[1] ** 2)) ** 0.5 for i, v in rows if len(v) == 2 and i != 1000}
    assert [r.vec_id for r in sorted(out, key=lambda r: r.rank) if r.query_id == 1000] == sorted(cosine, key=lambda i: (-cosine[i], i))[:5]


def test_pipeline_stages(spark, docs, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out, none = stage(spark, docs, str(tmp_path)), stage(spark, docs.limit(0), str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns and none.columns == docs.columns
        assert out.count() and not none.count()
