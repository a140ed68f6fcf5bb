"""N-gram Jaccard join: blocked sparse products of the document by n-gram incidence.

1. Every document's distinct word shingles become sorted 64-bit hashes. Documents with the same
   set are one node (its key is a hash of the set), so copies cost one row, however many.
2. The incidence is cut into column blocks by hash. Each block counts the nodes of a column;
   columns with one node drop out, as they can't add to an overlap.
3. A node needs ceil(t * n) shared columns for any link. If fewer of its columns are shared, it
   is out; else two linked nodes share one of the n - ceil(t * n) + 1 rarest columns of each.
4. Nodes that meet in such a column go to the group of that column's pivot, the node with the
   largest share of shared columns. Groups are cut into pairs of row blocks; each multiplies
   its incidence rows in column blocks, accumulates overlap counts and drops pairs below the
   bound that follows from the two sizes. Nodes linked with the pivot are already connected, so
   only pairs with another node are multiplied, and a block pair returns a spanning forest of its
   links, which has fewer links than nodes.
5. Connected components of these links, over nodes, give the classes of all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm.hashing import U, mix, utf8_column
from loomstone.llm.runtime import components, lean, materialise, small_batches, text_bytes
from loomstone.llm.shingles import shingle_rows

#: A column block holds about so many incidences, a map task packs so many before it sends them.
BLOCK_INCIDENCES, PACKED = 1_500_000, 800_000
ROW_BLOCK, COLUMN_BLOCK = 1024, 4096


def set_key(hashes: np.ndarray) -> int:
    """One signed 64-bit key for a sorted set of hashes."""
    rank = np.arange(len(hashes), dtype=U)
    return int(mix(np.array([mix(hashes + rank * U(0x9E3779B97F4A7C15)).sum(dtype=U) + U(len(hashes))]))[0].astype(np.int64))


def document_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, node): the size of each document's set and its node, null if empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, node = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for i, h in shingle_rows(*utf8_column(batch.column(1))):
                size[i], node[i] = len(h), set_key(h) if len(h) else 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(node, mask=size == 0)], ["doc_id", "n_shingles", "node"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), "doc_id long, n_shingles long, node long")


def _incidence(docs: DataFrame, n_blocks: int) -> DataFrame:
    """Packed incidences by column block: node keys, their set sizes, columns of each, and hashes.

    A set that a task has met already is left out: copies are combined before the shuffle."""

    def pack(nodes: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        h, sizes = np.concatenate(sets), np.array([len(x) for x in sets])
        block = ((h >> U(32)) * U(n_blocks) >> U(32)).astype(np.int32)
        order = np.argsort(block, kind="stable")
        row, h, block = np.repeat(np.arange(len(sets)), sizes)[order], h[order], block[order]
        cut = np.flatnonzero(np.diff(block, prepend=-1))
        keys, out = np.array(nodes, np.int64), []
        for a, b in zip(cut, [*cut[1:], len(h)], strict=True):
            at = np.flatnonzero(np.diff(row[a:b], prepend=-1))
            counts = np.diff(np.append(at, b - a)).astype(np.int32)
            own = row[a:b][at]
            out.append((int(block[a]), keys[own].tobytes(), sizes[own].astype(np.int32).tobytes(), counts.tobytes(), h[a:b].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), *[pa.binary()] * 4), strict=True)], ["block", "nodes", "sizes", "counts", "hashes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        nodes: list[int] = []
        sets: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for _, h in shingle_rows(*utf8_column(batch.column(0))):
                if not len(h) or (key := set_key(h)) in met:
                    continue
                met.add(key)
                nodes.append(key)
                sets.append(h)
                held += len(h)
                if held >= PACKED:
                    yield pack(nodes, sets)
                    nodes, sets, held = [], [], 0
        if sets:
            yield pack(nodes, sets)

    return docs.select("text").mapInArrow(lean(run), "block int, nodes binary, sizes binary, counts binary, hashes binary")


def _joined(column: pd.Series, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind)


def _firsts(x: np.ndarray) -> np.ndarray:
    """Indices where a run of equal values begins."""
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, int)


def _shared_columns(n_blocks: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Of one column block: the columns that more than one node has, with their counts, packed
        for as many row blocks of nodes as there are column blocks."""
        counts = _joined(pdf["counts"], np.int32)
        node, n = np.repeat(_joined(pdf["nodes"], np.int64), counts), np.repeat(_joined(pdf["sizes"], np.int32), counts)
        h = _joined(pdf["hashes"], U)
        order = np.lexsort((node, h))
        node, n, h = node[order], n[order], h[order]
        new = np.append(True, (h[1:] != h[:-1]) | (node[1:] != node[:-1]))[: len(h)]
        node, n, h = node[new], n[new], h[new]
        run = np.diff(np.append(_firsts(h), len(h)))
        df = np.repeat(run, run)
        rows = ((node.view(U) >> U(32)) * U(n_blocks) >> U(32)).astype(np.int32)
        keep = np.flatnonzero(df > 1)
        keep = keep[np.argsort(rows[keep], kind="stable")]
        node, n, h, df, rows = node[keep], n[keep], h[keep], df[keep].astype(np.int32), rows[keep]
        at = _firsts(rows)
        spans = list(zip(at, np.append(at, len(rows))[1:], strict=True))
        return pd.DataFrame({"rows": rows[at], **{k: [x[a:b].tobytes() for a, b in spans] for k, x in (("nodes", node), ("sizes", n), ("hashes", h), ("counts", df))}})

    return run


def _survivors(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Of one row block: (node, n, shared columns, prefix, share) where a link is possible."""
        node, n, h, df = (_joined(pdf[k], t) for k, t in (("nodes", np.int64), ("sizes", np.int32), ("hashes", U), ("counts", np.int32)))
        order = np.lexsort((h, df, node))
        node, n, h = node[order], n[order].astype(np.int64), h[order]
        at = _firsts(node)
        out = []
        for a, b in zip(at, np.append(at, len(node))[1:], strict=True):
            most = b - a - -(-percent * n[a] // 100) + 1
            if most > 0:
                out.append((node[a], n[a], h[a:b].tobytes(), h[a : a + most].view(np.int64), (b - a) / n[a]))
        return pd.DataFrame(out, columns=["node", "n", "columns", "prefix", "share"])

    return run


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Counts of common columns of each left and right row, accumulated over column blocks."""
    names, place = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    row = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    order = np.argsort(place, kind="stable")
    place, row = place[order], row[order]
    total = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, len(names), COLUMN_BLOCK):
        a, b = np.searchsorted(place, [start, start + COLUMN_BLOCK])
        part = np.zeros((len(left) + len(right), min(COLUMN_BLOCK, len(names) - start)), np.float32)
        part[row[a:b], place[a:b] - start] = 1
        total += part[: len(left)] @ part[len(left) :].T
    return total


def _block_links(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Links of one pair of row blocks of a pivot's group, as a spanning forest."""
        pdf = pdf.drop_duplicates("node").reset_index(drop=True)
        node, n, side = pdf["node"].to_numpy(), pdf["n"].to_numpy(), pdf["side"].to_numpy()
        rows = [np.frombuffer(x, U) for x in pdf["columns"]]
        parent = list(range(len(node)))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        found = []

        def link(lefts: np.ndarray, rights: np.ndarray) -> None:
            need = lambda i, j: percent * (n[i][:, None] + n[j][None, :])
            overlap = _overlaps([rows[i] for i in lefts], [rows[i] for i in rights])
            for i, j in zip(*np.nonzero((100 + percent) * overlap.astype(np.int64) >= need(lefts, rights)), strict=True):
                a, b = root(lefts[i]), root(rights[j])
                if a != b:
                    parent[a] = b
                    found.append((node[lefts[i]], node[rights[j]]))

        pivot = np.flatnonzero(node == pdf["pivot"].iloc[0])
        every = np.arange(len(node))
        for part in np.array_split(every, -(-len(every) // ROW_BLOCK)):
            link(pivot, part)
        done = np.array([root(i) == root(pivot[0]) for i in every])
        rest = every[~done]
        rest = rest[np.argsort(n[rest], kind="stable")]
        sides, met = sorted(set(side[side >= 0])), np.zeros(len(node), bool)
        for own in sides:
            # Two row blocks are multiplied with each other, one with itself; the pivot has met all.
            across = (side >= 0) & ((side != own) if len(sides) > 1 else True)
            mine = rest[side[rest] == own]
            for a in np.array_split(mine, -(-len(mine) // 256)) if len(mine) else []:
                # Size bound: 100 * smaller >= percent * larger, or the pair is dropped unmultiplied.
                other = every[across & ~met & (100 * n >= percent * n[a].min()) & (percent * n <= 100 * n[a].max())]
                for part in np.array_split(other, -(-len(other) // ROW_BLOCK)) if len(other) else []:
                    link(a, part)
                met[a] = True
        return pd.DataFrame(found, columns=["a", "b"]).astype({"a": "int64", "b": "int64"})

    return run


def jaccard_links(docs: DataFrame, percent: int = 75) -> DataFrame:
    """(a, b): links between nodes whose components are those of all links with
    100 * |intersection| >= percent * |union|."""
    small_batches(docs.sparkSession)
    n_blocks = max(16, text_bytes(docs) // 6 // BLOCK_INCIDENCES)
    shared = _incidence(docs, n_blocks).groupBy("block").applyInPandas(_shared_columns(n_blocks), "rows int, nodes binary, sizes binary, hashes binary, counts binary")
    kept = materialise(shared.groupBy("rows").applyInPandas(_survivors(percent), "node long, n long, columns binary, prefix array<long>, share double"), "jaccard-nodes")
    meet = kept.select(F.explode("prefix").alias("column"), "node", "share")
    best = meet.groupBy("column").agg(F.max(F.struct("share", "node")).alias("m"), F.count("*").alias("c")).where("c > 1")
    member = meet.join(best.select("column", F.col("m.node").alias("pivot")), "column").where("node <> pivot").select("pivot", "node").distinct()
    group = member.groupBy("pivot").agg(F.ceil(F.count("*") / ROW_BLOCK).cast("int").alias("k"))
    spread = member.join(group, "pivot").withColumn("side", F.pmod(F.xxhash64("node", F.lit(7)), F.col("k")).cast("int"))
    # Row block i meets each block j, itself included; the task of (i, j) with i <= j has both.
    grid = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select("pivot", "node", "side", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"))
    tasks = grid.select("pivot", "i", "j").distinct().select("pivot", F.col("pivot").alias("node"), F.lit(-1).alias("side"), "i", "j")
    rows = grid.unionByName(tasks).join(kept.select("node", "n", "columns"), "node")
    return rows.groupBy("pivot", "i", "j").applyInPandas(_block_links(percent), "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id) of all documents; linked ones have the same component_id.

    docs: doc_id, text; further columns are ignored. A text of any length is one set, made by one task. A null or empty text, or one of white space
    only, has no shingles and is its own component. Equal texts are linked. Rows that repeat a
    doc_id each keep a row; a null doc_id takes part in links, and its component_id is null only
    if no document of its component has an id. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    sets = materialise(document_sets(docs), "jaccard-sets")
    links = materialise(jaccard_links(docs, percent), "jaccard-links")
    classes = components(links, "jaccard")
    # One row for each node, then one for each class: copies are combined before they are shuffled, and the
    # names go back by joins of written tables, whose skewed partitions Spark can split.
    nodes = sets.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least")).join(classes, "node", "left")
    nodes = materialise(nodes.select("node", F.coalesce("component", "node").alias("class"), "least"), "jaccard-classes")
    named = materialise(nodes.groupBy("class").agg(F.min("least").alias("component_id")), "jaccard-names")
    named = materialise(nodes.join(named, "class").select("node", "component_id"), "jaccard-named")
    out = sets.join(named, "node", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


ORACLE_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM words WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(s) AS n FROM documents LEFT JOIN shingles USING (doc_id) GROUP BY doc_id
), links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM shingles x JOIN shingles y USING (s) JOIN sizes p ON p.doc_id = x.doc_id JOIN sizes q ON q.doc_id = y.doc_id
  WHERE x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= 75 * (p.n + q.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
)
SELECT doc_id, n AS n_shingles, component_id FROM sizes JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)
"""
