"""The pipeline's stages against plain Python, on a small folder."""

import random
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from loomstone.llm import bpe, mixing

from test_results import near, shingles

SHARED = [f"a line of more than twenty characters that number {k} shares" for k in range(3)]


def made():
    draw = random.Random(6)
    word = lambda k: [f"w{draw.randrange(10**9)}" for _ in range(k)]
    passage, out = word(34), []
    for f in range(12):
        body = word(90)
        for i in range(3):
            lines = [" ".join(body + word(10)), *draw.sample(SHARED, draw.randrange(3)), "end"]
            out.append((100 * f + i, "bad" if draw.random() < 0.2 else "good", "\n".join(lines)))
        out.append((100 * f + 9, "good", " ".join(body + passage)))
    out += [(2000 + i, "good", " ".join(passage + word(200))) for i in range(8)] + [(3000, "good", None), (3001, "good", ""), (3002, "bad", "")]
    return [(i, t, "en", ("a", "b", "c")[i % 3] if i < 3000 else "none", q) for i, q, t in out]


def without_repeats(texts):
    keeper = {}
    for i, t in texts.items():
        for line in t.split("\n"):
            keeper[line] = max(i, keeper.get(line, i))
    return {i: "\n".join(x for x in t.split("\n") if len(x) < 20 or keeper[x] == i) for i, t in texts.items()}


def targets(of):
    """Word targets of sources: weights 5, 2, 1 in turn, none over twice its size."""
    names, out, full = sorted(of), {}, 1.5 * sum(of.values())
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    while over := [s for s in names if s not in out and full * weight[s] / sum(weight[x] for x in names if x not in out) > 2 * of[s]]:
        out |= {s: 2 * of[s] for s in over}
        full -= sum(2 * of[s] for s in over)
    rest = [s for s in names if s not in out]
    return out | {s: full * weight[s] / sum(weight[x] for x in rest) for s in rest}


def test_pipeline_against_plain_python(spark, tmp_path, monkeypatch):
    rows = made()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, mark string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    # The scores themselves are held against labels in test_results.py.
    monkeypatch.setattr(corpus_pipeline.quality, "score_quality", lambda docs, labels: F.when(F.col("mark") == "bad", 0.29).otherwise(0.3))
    seen, keep = [], corpus_pipeline.materialise
    monkeypatch.setattr(corpus_pipeline, "materialise", lambda df, name: seen.append(keep(df, name)) or seen[-1])
    tokens = corpus_pipeline.run(spark, str(tmp_path)).collect()
    stages = [[(r.doc_id, r.text) for r in df.collect()] for df in seen]

    kept = {i: t for i, t, _, _, mark in rows if mark == "good"}
    assert len(stages[0]) == len(kept) and dict(stages[0]) == kept
    lines = without_repeats({i: t or "" for i, t in kept.items()})
    assert len(stages[1]) == len(lines) and dict(stages[1]) == lines
    least = near({i: shingles(t) for i, t in lines.items()})
    single = {i: t for i, t in lines.items() if least[i] == i}
    assert len(single) < len(lines) and len(stages[2]) == len(single) and dict(stages[2]) == single

    source, of, taken = {i: s for i, _, _, s, _ in rows}, Counter(), Counter()
    for i, t in single.items():
        of[source[i]] += len(t.split())
    assert max(Counter(i for i, _ in stages[3]).values()) <= 2
    for i, t in stages[3]:
        assert t == single[i] or t in " ".join(single[i].split()) or not Counter(t.split()) - Counter(single[i].split())
        taken[source[i]] += len(t.split())
    assert all(abs(taken[s] - n) <= mixing.BLOCK_WORDS for s, n in targets(of).items())

    own = bpe.encoding(*bpe.defaults())
    assert sorted((r.doc_id, r.n_tokens, r.ids, r.lossless) for r in tokens) == sorted((i, len(x), x, True) for i, x in ((i, own.encode_ordinary(t)) for i, t in stages[3]))
