"""Toxicity: a counterfactually regularised classifier.

A logistic model over hashed words and word beginnings that a text has. For labelled
sentences, identity terms are swapped for others, and a change of the score is penalised, so
that the mention of a group alone doesn't move it. Weights are sparse (FTRL-proximal, L1).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.llm.features import hashed_features
from loomstone.llm.labelled import held_out, sample
from loomstone.llm.runtime import small_batches

#: Labelled documents that training reads at most.
MAX_TRAIN_ROWS = 12000
BITS, PREFIXES, EPOCHS, BATCH, ALPHA, L1, L2, PENALTY, MIN_DOCS = 21, (4, 5, 6, 7, 8, 9), 5, 32, 0.5, 1.0, 1.0, 0.5, 4
#: Terms by axis; a term is swapped for another of its axis.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "woman", "man", "transgender", "nonbinary"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "sikh"),
    ("black", "white", "asian", "latino", "african", "european", "indigenous", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "queer", "heterosexual"),
    ("immigrant", "refugee", "citizen", "foreigner", "native"),
    ("disabled", "deaf", "blind", "autistic", "elderly", "young"),
)
_WORD = re.compile(r"[^\W\d_]+")


def swapped(text: str, key: int, terms: Sequence[Sequence[str]] = IDENTITY_TERMS) -> tuple[str, str]:
    """Two versions of one sentence of text that differ in identity terms alone.

    The first sentence with such a term, with that term and another of its axis; else a sentence
    chosen by key, one word of which becomes a term in one version and its swap in the other.
    """
    axis = {term: group for group in terms for term in group}
    sentences = [s for s in re.split(r"[.!?\n]+", text) if _WORD.search(s)] or ["a"]
    for s in sentences:
        for m in _WORD.finditer(s):
            if group := axis.get(m[0].lower()):
                other = group[(group.index(m[0].lower()) + 1 + key % (len(group) - 1)) % len(group)]
                return s, s[: m.start()] + other + s[m.end() :]
    s = sentences[key % len(sentences)]
    words = list(_WORD.finditer(s))
    m, group = words[key // 7 % len(words)], terms[key // 49 % len(terms)]
    a = key // 343 % len(group)
    b = (a + 1 + key // 2401 % (len(group) - 1)) % len(group)
    return tuple(s[: m.start()] + group[x] + s[m.end() :] for x in (a, b))


def _present(texts: Sequence[str]) -> list[np.ndarray]:
    out = []
    for a, b, row, bucket in hashed_features(texts, BITS, (), letters_only=True, prefixes=PREFIXES):
        both = np.unique(row << BITS | bucket)
        cut = np.searchsorted(both, np.arange(b - a + 1) << BITS)
        out += [(both[cut[i] : cut[i + 1]] & (1 << BITS) - 1).astype(np.int32) for i in range(b - a)]
    return out


def fit(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], y: np.ndarray) -> np.ndarray:
    """rows: features of the text and of the two versions of a sentence. The last weight is the bias."""
    size, rng = (1 << BITS) + 1, np.random.default_rng(5)
    seen = np.zeros(size, np.int32)
    for x, _, _ in rows:
        seen[x] += 1
    keep = seen >= MIN_DOCS
    for a, b in ((a, b) for _, a, b in rows):  # the terms' own features count, however rare
        keep[np.setxor1d(a, b)] = True
    cut = [tuple(f[keep[f]] for f in row) for row in rows]
    z, n, bias = np.zeros(size), np.zeros(size), size - 1

    def weights(at: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z[at]) <= L1, 0, -(z[at] - np.sign(z[at]) * L1) / (1 / ALPHA + np.sqrt(n[at]) / ALPHA + L2))

    for _ in range(EPOCHS):
        order = rng.permutation(len(cut))
        for start in range(0, len(cut), BATCH):
            pick = order[start : start + BATCH]
            parts, owner = [], []
            for k, i in enumerate(pick):
                for side, f in enumerate(cut[i]):
                    parts.append(f)
                    owner.append(np.full(len(f), 3 * k + side))
            name, place = np.unique(np.concatenate([*parts, [bias]]), return_inverse=True)
            place, owner = place[:-1], np.concatenate(owner)
            w = weights(name)
            logit = np.bincount(owner, w[place], minlength=3 * len(pick)).reshape(-1, 3)
            main = logit[:, 0] + w[-1]
            grad = np.zeros_like(logit)
            grad[:, 0] = 1 / (1 + np.exp(-np.clip(main, -30, 30))) - y[pick]
            change = 2 * PENALTY * np.clip(logit[:, 1] - logit[:, 2], -1, 1)
            grad[:, 1], grad[:, 2] = change, -change
            g = np.bincount(place, grad.ravel()[owner], minlength=len(name))
            g[-1] += grad[:, 0].sum()
            step = (np.sqrt(n[name] + g * g) - np.sqrt(n[name])) / ALPHA
            z[name] += g - step * w
            n[name] += g * g
    return weights(np.arange(size)).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = MAX_TRAIN_ROWS) -> np.ndarray:
    """2**BITS + 1 float32 weights, whatever the size of docs. Features are taken in parallel, and
    the bounded sample's features are fitted in one task. Without two classes in the sample,
    scores follow its one class (0.5 if there is none)."""

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pairs = [swapped(t, zlib.crc32(t.encode())) for t in pdf["text"]]
            out = [_present(x) for x in (list(pdf["text"]), [a for a, _ in pairs], [b for _, b in pairs])]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "y": pdf["y"], **{k: [f.tobytes() for f in x] for k, x in zip("fab", out, strict=True)}})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = sorted((x for pdf in batches for x in zip(pdf["doc_id"], pdf["y"], pdf["f"], pdf["a"], pdf["b"], strict=True)), key=lambda x: x)
        y = np.array([x[1] for x in rows], np.float64)
        model = np.zeros((1 << BITS) + 1, np.float32)
        if len(set(y)) == 2:
            model = fit([tuple(np.frombuffer(f, np.int32) for f in x[2:]) for x in rows], y)
        elif len(y):
            model[-1] = 4.0 * (2 * y[0] - 1)
        yield pd.DataFrame({"model": [model.tobytes()]})

    small_batches(docs.sparkSession)
    rows = sample(docs, labels, label, most).mapInPandas(features, "doc_id long, y int, f binary, a binary, b binary")
    found = rows.repartition(1).mapInPandas(run, "model binary").collect()
    return np.frombuffer(found[0][0], np.float32) if found else np.zeros((1 << BITS) + 1, np.float32)


def scorer(spark, model: np.ndarray):
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weight, bias = shared.value[:-1], float(shared.value[-1])
        for texts in batches:
            texts = texts.fillna("").tolist()
            out = np.full(len(texts), bias)
            for a, b, row, bucket in hashed_features(texts, BITS, (), letters_only=True, prefixes=PREFIXES):
                w = weight[bucket]
                hit = np.flatnonzero(w)
                once = np.unique(row[hit] << BITS | bucket[hit])
                out[a:b] += np.bincount(once >> BITS, weight[once & (1 << BITS) - 1], minlength=b - a)
            yield pd.Series(1 / (1 + np.exp(-np.clip(out, -30, 30))))

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = MAX_TRAIN_ROWS) -> Column:
    """A column of scores from 0 to 1 for docs' text; null and empty texts get the bias's score."""
    return scorer(docs.sparkSession, train(docs, labels, label, most))(F.col("text"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs; rows that repeat are scored alike.

    A null doc_id is not held out and never learned from. Null and empty texts get the bias's score; a very long text is scored whole,
    its features a run of texts at a time. Further columns of docs are ignored, whatever their names. An empty table gives no rows; without labels
    every score is 0.5.
    """
    score = score_toxicity(docs, labels)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
