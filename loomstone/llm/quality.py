"""Quality classifier: supervised subword embeddings.

Learned vectors of hashed words, word n-grams, patterns of word n-grams and character n-grams are averaged over a document and go
through a linear softmax. Features of a bounded sample of labelled
documents are taken in parallel and fitted by stochastic gradient descent in numpy, in one task; scored in parallel over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.llm.features import hashed_features
from loomstone.llm.labelled import held_out, sample
from loomstone.llm.runtime import small_batches

#: Labelled documents that training reads at most.
MAX_TRAIN_ROWS = 4000
BITS, DIM, GRAMS, WORD_GRAMS, PATTERNS, EPOCHS, BATCH, RATE, SEED = 17, 10, (3, 4), (2,), (3,), 8, 16, 1.0, 11
#: Zero vectors that each average holds besides a text's own, so that a few words don't decide alone.
PRIOR = 20


def _bags(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, shares) of each text: shares of all its features and the prior's."""
    out = []
    for a, b, row, bucket in hashed_features(texts, BITS, GRAMS, letters_only=False, word_grams=WORD_GRAMS, patterns=PATTERNS):
        order = np.lexsort((bucket, row))
        row, bucket = row[order], bucket[order]
        cut = np.searchsorted(row, np.arange(b - a + 1))
        for i in range(b - a):
            name, count = np.unique(bucket[cut[i] : cut[i + 1]], return_counts=True)
            out.append((name.astype(np.int32), (count / (PRIOR + count.sum())).astype(np.float32)))
    return out


def fit(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors (2**BITS, DIM) and softmax weights (DIM + 1, 2); the last row is the bias."""
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    weights = np.zeros((DIM + 1, 2), np.float32)
    steps, step = EPOCHS * -(-len(bags) // BATCH), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for start in range(0, len(bags), BATCH):
            rate = RATE * (1 - step / steps)
            step += 1
            pick = order[start : start + BATCH]
            means = np.array([share @ vectors[name] for name, share in (bags[i] for i in pick)], np.float32)
            inputs = np.hstack([means, np.ones((len(pick), 1), np.float32)])
            logits = inputs @ weights
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(pick)), y[pick]] -= 1
            back = p @ weights[:DIM].T
            weights -= rate * inputs.T @ p / len(pick)
            for i, g in zip(pick, back, strict=True):
                name, share = bags[i]
                # A document's shares are small: scaled by the number of its features, as if each was a step of its own.
                vectors[name] -= (rate * 20) * np.outer(share, g).astype(np.float32)
    return vectors, weights


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MAX_TRAIN_ROWS) -> np.ndarray:
    """The model as one float32 array of size 2**BITS + 1, whatever the size of docs.

    Averaging is linear, so a document's logit for label 1 is the mean over its features
    (and the prior's zeros) of vector . (w1 - w0), plus a bias: that number of each bucket is all that scoring needs. Without
    labelled rows, or with one class only, scores follow the share of label 1 (0.5 if there are none).
    """

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bags = _bags(list(pdf["text"]))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "y": pdf["y"], "names": [n.tobytes() for n, _ in bags], "shares": [s.tobytes() for _, s in bags]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = sorted((x for pdf in batches for x in zip(pdf["doc_id"], pdf["y"], pdf["names"], pdf["shares"], strict=True)), key=lambda x: x[:3])
        y = np.array([x[1] for x in rows], np.int64)
        model = np.zeros((1 << BITS) + 1, np.float32)
        if len(set(y)) == 2:
            vectors, weights = fit([(np.frombuffer(x[2], np.int32), np.frombuffer(x[3], np.float32)) for x in rows], y)
            model[:-1] = vectors @ (weights[:DIM, 1] - weights[:DIM, 0])
            model[-1] = weights[DIM, 1] - weights[DIM, 0]
        elif len(y):
            model[-1] = 4.0 * (2 * y[0] - 1)
        yield pd.DataFrame({"model": [model.tobytes()]})

    small_batches(docs.sparkSession)
    rows = sample(docs, labels, label, most).mapInPandas(features, "doc_id long, y int, names binary, shares binary")
    found = rows.repartition(1).mapInPandas(run, "model binary").collect()
    return np.frombuffer(found[0][0], np.float32) if found else np.zeros((1 << BITS) + 1, np.float32)


def scorer(spark, model: np.ndarray):
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        value, bias = shared.value[:-1], float(shared.value[-1])
        for texts in batches:
            texts = texts.fillna("").tolist()
            out = np.full(len(texts), bias)
            for a, b, row, bucket in hashed_features(texts, BITS, GRAMS, letters_only=False, word_grams=WORD_GRAMS, patterns=PATTERNS):
                n = np.bincount(row, minlength=b - a)
                out[a:b] += np.bincount(row, value[bucket], minlength=b - a) / (PRIOR + n)
            yield pd.Series(1 / (1 + np.exp(-np.clip(out, -30, 30))))

    return score


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MAX_TRAIN_ROWS) -> Column:
    """A column of scores from 0 to 1 for docs' text; null and empty texts get the bias's score."""
    return scorer(docs.sparkSession, train(docs, labels, label, most))(F.col("text"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs; rows that repeat are scored alike.

    A null doc_id is not held out and never learned from. Null and empty texts get the bias's score; a very long text is scored whole,
    its features a run of texts at a time. Further columns of docs are ignored, whatever their names. An empty table gives no rows; without labels
    every score is 0.5.
    """
    score = score_quality(docs, labels)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
