"""Approximate nearest neighbours by multi-index hashing.

Vectors become binary codes by rotations learned on a bounded sample (iterative quantisation).
Codes are split into substrings of 16 bits, and each substring is indexed. By the pigeonhole
principle a code within Hamming radius R of a query's has a substring within R // m of the
query's, m being the number of substrings; so probing every index that far finds all such
codes. They are reranked by the cosine of the original vectors. The radius is learned too, from a bounded number of queries against
all rows: the more rows, the nearer the nearest and the smaller the radius.

Where R // m is small, the index is a table of postings by (substring number, value), and queries meet it by an equality join on the
values that they probe. Where a query would probe more values than that pays for (vectors spread evenly over directions have no code
near any other), the same codes are found by comparing values in blocks: index and queries are cut, and each pair of blocks is one task.
Queries that find too few codes within the radius go to the blocks, too.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.llm.runtime import lean, materialise

#: Vectors that the rotations and the radius are learned from at most, and how many of them serve as queries.
MAX_FIT_ROWS, FIT_QUERIES = 4096, 512
BITS, STEPS, COVERED, INDEX_BLOCK, QUERY_BLOCK = 128, 15, 0.975, 8192, 1024
#: A query probes so many values of a substring at most in the table of postings: those that differ in three bits.
MOST_PROBES = 697
_POPCOUNT = np.array([i.bit_count() for i in range(1 << 16)], np.uint8)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def learn_rotations(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """(d, bits): orthogonal matrices side by side, each turned so that vectors lie near the corners
    of the cube that their signs name."""
    d = x.shape[1]
    out = []
    for _ in range(-(-BITS // d)):
        r, _ = np.linalg.qr(rng.standard_normal((d, d)))
        for _ in range(STEPS):
            u, _, v = np.linalg.svd(np.where(x @ r >= 0, 1.0, -1.0).T @ x)
            r = (u @ v).T
        out.append(r)
    return np.hstack(out)


def codes(x: np.ndarray, rotations: np.ndarray) -> np.ndarray:
    """(n, m) substrings of 16 bits; bits past the last rotation are 0."""
    bits = unit(x) @ rotations >= 0
    bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 16)))
    return np.packbits(bits, axis=1).view(np.uint16)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _POPCOUNT[a ^ b].sum(-1, dtype=np.int32)


def nearest_of_sample(index: DataFrame, asked: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The k nearest vectors in all of the index to each asked one, itself (by its id) left out: rows of vectors, some fewer than k are
    repeated. asked is bounded; tasks send k rows for each."""
    shared = index.sparkSession.sparkContext.broadcast((unit(asked), ids))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queries, own = shared.value
        best = [(np.zeros(0), np.zeros((0, queries.shape[1])))] * len(queries)
        for pdf in batches:
            x = np.stack(pdf["embedding"].to_numpy())
            cosine = queries @ unit(x).T
            cosine[own[:, None] == pdf["vec_id"].to_numpy()[None, :]] = -np.inf
            for q, row in enumerate(cosine):
                near = np.argpartition(-row, min(k, len(row)) - 1)[:k]
                near = near[row[near] > -np.inf]
                score, vectors = np.append(best[q][0], row[near]), np.vstack([best[q][1], x[near]])
                keep = np.argsort(-score, kind="stable")[:k]
                best[q] = score[keep], vectors[keep]
        yield pd.DataFrame([(q, c, v) for q, (score, vectors) in enumerate(best) for c, v in zip(score.tolist(), vectors, strict=True)], columns=["q", "c", "v"])

    found = index.select("vec_id", "embedding").mapInPandas(lean(run), "q int, c double, v array<double>")
    top = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("c"), "v"))).where(F.col("r") <= k).select("q", "v").toPandas()
    return [np.stack(g.to_numpy()) for _, g in top.groupby("q")["v"]] if len(top) else []


def fit(index: DataFrame, k: int, seed: int = 3) -> tuple[np.ndarray, int]:
    """Rotations from a sample of rows, and a radius that holds COVERED of the sample queries' k nearest among all rows."""
    sample = index.orderBy(F.xxhash64("vec_id"), "vec_id").limit(MAX_FIT_ROWS).toPandas()
    vectors = np.stack(sample["embedding"].to_numpy())
    rotations = learn_rotations(unit(vectors), np.random.default_rng(seed))
    asked = vectors[:FIT_QUERIES]
    near = nearest_of_sample(index, asked, sample["vec_id"].to_numpy()[:FIT_QUERIES], k)
    code = codes(asked, rotations)
    away = [hamming(codes(v, rotations), code[q]) for q, v in enumerate(near)]
    return rotations, int(np.quantile(np.concatenate(away), COVERED, method="higher")) if away else 0


def _masks(most: int) -> np.ndarray:
    return np.flatnonzero(_POPCOUNT <= most).astype(np.uint16)


def search_block(index_ids: np.ndarray, index: np.ndarray, queries: np.ndarray, rotations: np.ndarray, radius: int, k: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(query row, ids, cosines) of each query's k best of this block: all codes within the radius,
    or within the distance of the k-th nearest code if that is larger, reranked by cosine."""
    code, asked = codes(index, rotations), codes(queries, rotations)
    m = code.shape[1]
    reach = radius // m
    tables = [np.unique(code[:, j], return_inverse=True) for j in range(m)]
    probes = sum(comb(16, i) for i in range(reach + 1))
    masks = _masks(reach)
    norm, asked_norm = np.linalg.norm(index, axis=1), np.linalg.norm(queries, axis=1)
    out = []
    for start in range(0, len(queries), 64):
        part = asked[start : start + 64]
        found = np.zeros((len(part), len(code)), bool)
        for j, (values, place) in enumerate(tables):
            if probes < len(values):  # look up every value in reach
                hit = np.zeros((len(part), 1 << 16), bool)
                np.put_along_axis(hit, (part[:, j, None] ^ masks[None, :]).astype(np.int64), True, axis=1)
                hit = hit[:, values]
            else:  # fewer values are there than in reach
                hit = _POPCOUNT[part[:, j, None] ^ values[None, :]] <= reach
            found |= hit[:, place]
        for q in range(len(part)):
            near = np.flatnonzero(found[q])
            near = near[hamming(code[near], part[q]) <= radius]
            if len(near) < k:
                away = hamming(code, part[q])
                near = np.flatnonzero(away <= np.partition(away, min(k, len(away)) - 1)[min(k, len(away)) - 1])
            row = start + q
            score = np.einsum("ij,ij->i", index[near], np.broadcast_to(queries[row], (len(near), index.shape[1]))) / (norm[near] * asked_norm[row])
            best = np.lexsort((index_ids[near], -score))[:k]
            out.append((row, index_ids[near][best], score[best]))
    return out


def usable(vector: Column) -> Column:
    """Whether the vector is neither null nor zero, and all its components are finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): of each query its k nearest other rows by cosine.

    vectors: vec_id, embedding; further columns are ignored. Ties go to the smaller vec_id. Rows
    with a null vec_id or an unusable vector take no part. Vectors of each length are fitted and
    searched by themselves, one length after the other. A row given twice counts once. Of equal vectors
    the k + 1 smallest vec_ids are searched, as no others can be among a query's k nearest; equal
    queries are searched once. Without usable rows there is no result.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), is_query.alias("is_query"))
    rows = materialise(rows.distinct(), "vectors")
    lengths = rows.where("is_query").select(F.size("embedding").alias("d")).distinct().orderBy("d").collect()
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.unionByName, [_nearest_of_length(rows.where(F.size("embedding") == r.d), k) for r in lengths])


def _nearest_of_length(rows: DataFrame, k: int) -> DataFrame:
    """nearest() for distinct usable rows (vec_id, embedding, is_query) of one length, a query among them."""
    spark = rows.sparkSession
    first = Window.partitionBy("embedding").orderBy("vec_id")
    index = materialise(rows.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1).select("vec_id", "embedding"), "vector-index")
    asked = rows.where("is_query").withColumn("key", F.min("vec_id").over(Window.partitionBy(F.xxhash64("embedding"), "embedding")))
    asked = materialise(asked, "vector-queries")
    keys = asked.where("vec_id = key").select("vec_id", "embedding")
    rotations, radius = fit(index, k)
    model = spark.sparkContext.broadcast((rotations, radius))
    found, rest = None, keys
    if sum(comb(16, i) for i in range(radius // (-(-rotations.shape[1] // 16)) + 1)) <= MOST_PROBES:
        found = materialise(_probed(index, keys, model, k), "vector-probed")
        full = found.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > k).select("key")
        rest, enough = keys.join(full.withColumnRenamed("key", "vec_id"), "vec_id", "left_anti"), found.join(full, "key", "left_semi")
    scanned = _scanned(index, rest, model, k)
    found = scanned if found is None else enough.unionByName(scanned)
    order = [F.desc("score"), F.col("vec_id")]
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(*order))).where(F.col("r") <= k + 1)
    own = asked.select(F.col("vec_id").alias("query_id"), "key").join(best.select("key", "vec_id", "score"), "key").where("vec_id <> query_id")
    ranked = own.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "key").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _probed(index: DataFrame, keys: DataFrame, model, k: int) -> DataFrame:
    """(key, vec_id, score): the k + 1 best of all codes within the radius of each query's, from the table of postings."""
    radius = model.value[1]

    @F.pandas_udf("array<int>")
    def code_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series(list(codes(np.stack(x.to_numpy()), model.value[0]).astype(np.int32)))

    m = -(-model.value[0].shape[1] // 16)
    masks = F.array(*[F.lit(int(x)) for x in _masks(radius // m)])  # MOST_PROBES at most
    coded = lambda df, name: df.select(F.col("vec_id").alias(name), code_of("embedding").alias(f"{name}_code"))
    posts = coded(index, "vec_id").select("vec_id", "vec_id_code", F.posexplode("vec_id_code").alias("part", "value"))
    asks = coded(keys, "key").select("key", "key_code", F.posexplode("key_code").alias("part", "own")).withColumn("mask", F.explode(masks))
    asks = asks.select("key", "key_code", "part", F.col("own").bitwiseXOR(F.col("mask")).alias("value"))
    away = F.aggregate(F.zip_with("vec_id_code", "key_code", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, v: s + v)
    pairs = asks.join(posts, ["part", "value"]).where(away <= radius).select("key", "vec_id").distinct()
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    scored = pairs.join(index.select("vec_id", F.col("embedding").alias("x")), "vec_id").join(keys.select(F.col("vec_id").alias("key"), F.col("embedding").alias("q")), "key")
    scored = scored.select("key", "vec_id", (dot("x", "q") / (F.sqrt(dot("x", "x")) * F.sqrt(dot("q", "q")))).alias("score"))
    best = scored.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")))
    return best.where(F.col("r") <= k + 1).select("key", "vec_id", "score")


def _scanned(index: DataFrame, keys: DataFrame, model, k: int) -> DataFrame:
    """(key, vec_id, score): the same by pairs of blocks, for each block of the index; queries without k + 1 codes within the radius
    take the nearest codes beyond it."""
    i_blocks, q_blocks = -(-index.count() // INDEX_BLOCK), max(1, -(-keys.count() // QUERY_BLOCK))

    def block(n: int) -> Column:
        return F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    grid = index.select(block(i_blocks).alias("i"), every(q_blocks).alias("q"), F.lit(False).alias("asks"), "vec_id", "embedding")
    grid = grid.unionByName(keys.select(every(i_blocks).alias("i"), block(q_blocks).alias("q"), F.lit(True).alias("asks"), "vec_id", "embedding"))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf["asks"].to_numpy()
        x, ids = np.stack(pdf["embedding"].to_numpy()), pdf["vec_id"].to_numpy()
        if asks.all() or not asks.any():
            return pd.DataFrame({"key": [], "vec_id": [], "score": []})
        found = search_block(ids[~asks], x[~asks], x[asks], *model.value, k + 1)
        return pd.DataFrame({"key": np.repeat(ids[asks], [len(f[1]) for f in found]), "vec_id": np.concatenate([f[1] for f in found]), "score": np.concatenate([f[2] for f in found])})

    return grid.groupBy("i", "q").applyInPandas(search, "key long, vec_id long, score double")


def search_fiftieths(vectors: DataFrame) -> DataFrame:
    """The five nearest of every row whose vec_id is divisible by 50."""
    return nearest(vectors, F.pmod(F.col("vec_id"), F.lit(50)) == 0)
