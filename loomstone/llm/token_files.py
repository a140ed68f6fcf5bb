"""Token-id files: documents' ids in ascending doc_id order, in checksummed range-coded blocks.

A file is a Parquet table of segments of up to SEGMENT_IDS ids, as one stream cut into blocks that
range_coder codes independently: (part, seg) gives a segment's place in the order, docs, doc_ids and lengths
describe its documents (their number within the part, their id, and how many of their ids are in the
segment: a long document goes on in the next), payloads and checksums its blocks. A damaged
block is found by its checksum, and only its own ids are lost.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstone.llm import range_coder
from loomstone.llm.prefix import prefix_sums
from loomstone.llm.runtime import lean, materialise, partitions, shared_dir, small_batches, text_bytes

SEGMENT_IDS, END = 8_000_000, 2
#: UTF-8 bytes of text that a part of the files holds, about.
PART_BYTES = 256_000_000
#: Words whose ids a worker keeps at most, before it starts anew: about 200 MB.
_CACHED = 1_000_000
#: Code points of a text, and texts, that go through the tokenizer at once.
_SLICE, _TEXTS = 4_000_000, 10_000
#: Texts of these characters are in NFC, lower-case as the tokenizer does, and split as below.
_PLAIN = re.compile("[\t\n\x0b\x0c\r -~À-ÖØ-öø-ÿ]*")
#: By the code of a plain character: its lower case, and white space, letter, digit or other.
_LOWER = bytes(ord(chr(i).lower()) if _PLAIN.fullmatch(chr(i)) else i for i in range(256))
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
_KIND = np.array([_SPACE if chr(i).isspace() else _LETTER if re.match("[a-zß-öø-ÿ]", chr(i)) else _DIGIT if chr(i) in "0123456789" else _OTHER for i in range(256)], np.uint8)
#: Contractions by their second letter, and those of three letters by their second and third.
_SHORT, _LONG = np.frombuffer(b"stmd", np.uint8), np.frombuffer(b"reve" b"ll", "<u2")
#: Bytes as the characters that the vocabulary writes for them: itself, or one from 256 on; a line feed stays, to part words.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_WRITTEN = np.arange(256, dtype="<u2")
_WRITTEN[[b for b in range(256) if b not in _SHOWN]] = np.arange(256, 512 - len(_SHOWN))
_WRITTEN[ord("\n")] = ord("\n")
#: Where a long text may be cut: the vocabulary of the default path drops white space and starts words anew after it.
_CUT = re.compile("[ \n][A-Za-z]")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class _Words:
    """Ids of words that a worker has met: where each one's ids lie in one array."""

    def __init__(self) -> None:
        self.place: dict[bytes, int] = {}
        self.ids, self.starts, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def learn(self, words: list[bytes], ids: np.ndarray, counts: np.ndarray) -> None:
        self.place.update(zip(words, range(len(self.place), len(self.place) + len(words)), strict=True))
        self.starts = np.append(self.starts, (len(self.ids) + np.cumsum(counts) - counts).astype(np.int32))
        self.counts = np.append(self.counts, counts)
        self.ids = np.append(self.ids, ids)

    def ids_of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words at these places, and where each word's end."""
        counts = self.counts[at]
        ends = np.cumsum(counts, dtype=np.int64)
        return self.ids[np.repeat(self.starts[at] - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)], ends


@lru_cache(maxsize=2)
def _known(path: str) -> list[_Words]:
    return [_Words()]


def _pieces(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The words of plain texts in lower case, in Latin-1, and how many of them lie before each text and before the end.

    As the vocabulary splits: contractions, runs of letters, single digits, runs of others; white space drops out."""
    raw = np.frombuffer(" ".join(["", *texts, "  "]).encode("latin-1").translate(_LOWER), np.uint8)
    kind = _KIND[raw]
    starts = np.append(False, kind[1:] != kind[:-1]) | (kind == _DIGIT)
    word = kind != _SPACE
    starts &= word
    quote = np.flatnonzero(starts & (raw == ord("'")))
    short, long = np.isin(raw[quote + 1], _SHORT), np.isin(raw[quote + 1] | raw[quote + 2].astype(np.uint16) << 8, _LONG)
    quote, long = quote[short | long], long[short | long]
    starts[quote + 1] = False
    ends = quote + np.where(long, 3, 2)
    starts[ends] = word[ends]
    at = np.flatnonzero(starts)
    ends = np.cumsum(word, dtype=np.int32)
    places = np.append(ends[at] - np.int32(1), ends[-1:])
    words = pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(places), pa.py_buffer(raw[word])])
    return words, np.searchsorted(at, np.cumsum([1, *(len(t) + 1 for t in texts)]))


def _word_ids(words: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of words, and how many each has, by the library's own model, past its normalizer and splitter: the words are split and in lower case already."""
    tokenize, ids, counts = _tokenizer(path).model.tokenize, array("i"), array("i")
    written = _WRITTEN[np.frombuffer(b"\n".join(words).decode("latin-1").encode(), np.uint8)].tobytes().decode("utf-16-le")
    for word in written.split("\n"):
        found = tokenize(word)
        ids.extend([t.id for t in found])
        counts.append(len(found))
    return np.array(ids, np.int32), np.array(counts, np.int32)


def encode_texts(texts: list[str], path: str, by_word: bool = True) -> list[np.ndarray]:
    """Ids of each text by the tokenizers library, without added special tokens.

    The vocabulary of the default path splits into words before its merges. by_word uses that: in
    texts of plain characters each distinct word goes through the library once and is then known.
    """
    own = _tokenizer(path)
    out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(texts)
    plain = [i for i, t in enumerate(texts) if by_word and "<|" not in t and _PLAIN.fullmatch(t)]
    other = sorted(set(range(len(texts))) - set(plain))
    for k in range(0, len(other), 200):
        some = other[k : k + 200]
        for i, e in zip(some, own.encode_batch_fast([texts[i] for i in some], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, np.int32)
    words, before = _pieces([texts[i] for i in plain])
    if not len(words):
        return out
    if len(_known(path)[0].place) > _CACHED:
        _known(path)[0] = _Words()
    known, coded = _known(path)[0], words.dictionary_encode()
    distinct, place = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), known.place.get
    at = np.array([place(w, -1) for w in distinct], np.int32)
    new = np.flatnonzero(at < 0)
    if len(new):
        at[new] = len(known.place) + np.arange(len(new))
        names = [distinct[k] for k in new.tolist()]
        known.learn(names, *_word_ids(names, path))
    ids, ends = known.ids_of(at[coded.indices.to_numpy()])
    ends = np.append(0, ends)[before].tolist()
    for i, a, b in zip(plain, ends[:-1], ends[1:], strict=True):
        out[i] = ids[a:b]
    return out


def _cuts(text: str) -> list[str]:
    """A long text in slices that are tokenized alike on their own; text without a place to cut stays whole."""
    out, start = [], 0
    while len(text) - start > _SLICE and (m := _CUT.search(text, start + _SLICE)):
        out.append(text[start : m.start() + 1])
        start = m.start() + 1
    return [*out, text[start:]]


def text_ids(texts: list[str | None], path: str, by_word: bool) -> Iterator[np.ndarray]:
    """The ids of each text (null: none), for a bounded number of texts and of code points at once."""
    held: list[str] = []
    size = 0
    for text in texts:
        text = text or ""
        if len(text) > _SLICE and by_word:
            yield from encode_texts(held, path, by_word)
            held, size = [], 0
            yield np.concatenate([encode_texts([t], path, by_word)[0] for t in _cuts(text)])
            continue
        held.append(text)
        size += len(text)
        if len(held) >= _TEXTS or size > _SLICE:
            yield from encode_texts(held, path, by_word)
            held, size = [], 0
    yield from encode_texts(held, path, by_word)


_SEGMENT = "part int, seg int, n long, docs binary, doc_ids binary, no_id binary, lengths binary, payloads array<binary>, checksums array<long>"
_FIELDS = [("part", pa.int32()), ("seg", pa.int32()), ("n", pa.int64()), ("docs", pa.binary()), ("doc_ids", pa.binary()), ("no_id", pa.binary()), ("lengths", pa.binary()), ("payloads", pa.list_(pa.binary())), ("checksums", pa.list_(pa.int64()))]


def write(docs: DataFrame, folder: str, path: str | None = None, by_word: bool | None = None) -> None:
    """Writes (doc_id, text) in ascending doc_id order, null ids first, ties by the text's hash and the text; END closes each document.

    One function tokenizes and codes. It holds a segment's ids and one Arrow batch of texts, so a text longer than a
    segment is spread over several. Rows equal in both columns can't be dealt to different parts."""
    small_batches(docs.sparkSession)
    by_word = path is None if by_word is None else by_word
    path = path or default_path()
    n = partitions(docs.sparkSession, text_bytes(docs), PART_BYTES)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list[np.ndarray]]]:
        part, doc, names, held, size = 0, 0, [], [], 0
        for batch in batches:
            ids = text_ids(batch.column(2).to_pylist(), path, by_word)
            for part, name, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), ids, strict=True):
                own = np.append(own, np.int32(END))
                while len(own):
                    room = SEGMENT_IDS - size
                    names.append((doc, name))
                    held.append(own[:room])
                    size += len(held[-1])
                    own = own[room:]
                    if size == SEGMENT_IDS:
                        yield part, names, held
                        names, held, size = [], [], 0
                doc += 1
        if names:
            yield part, names, held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, (part, names, held) in enumerate(segments(batches)):
            ids = np.concatenate(held)
            payloads, checksums = range_coder.encode(ids)
            row = {
                "part": part, "seg": k, "n": len(ids), "docs": np.array([d for d, _ in names], np.int64).tobytes(), "doc_ids": np.array([x or 0 for _, x in names], np.int64).tobytes(),
                "no_id": np.array([x is None for _, x in names]).tobytes(), "lengths": np.array([len(x) for x in held], np.int64).tobytes(), "payloads": payloads, "checksums": checksums,
            }
            yield pa.RecordBatch.from_pylist([row], pa.schema(_FIELDS))

    # Spark samples the columns that it deals by for the driver: a hash stands for the text there.
    tied = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    ordered = tied.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    ordered.select(F.spark_partition_id().alias("part"), "doc_id", "text").mapInArrow(lean(run), _SEGMENT).write.parquet(folder)


def read(spark: SparkSession, folder: str, checksums: bool = False) -> DataFrame:
    """(part, seg, at, doc, doc_id, ids): documents of the files, doc being their number in the part.

    at is the place of the first id in its segment. A document longer than a segment has a row for each of its segments. With
    checksums, n and crc32 (of the ids as little-endian unsigned 32-bit integers) stand in place of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(j)[k].as_py() for j, name in enumerate(batch.schema.names)}
                ids = range_coder.decode(range_coder.sizes_of(row["n"]), row["payloads"], row["checksums"])
                lengths = np.frombuffer(row["lengths"], np.int64)
                ends = np.cumsum(lengths)
                m = len(lengths)
                head = [pa.array(np.full(m, row["part"], np.int32)), pa.array(np.full(m, row["seg"], np.int32)), pa.array(ends - lengths), pa.array(np.frombuffer(row["docs"], np.int64)), pa.array(np.frombuffer(row["doc_ids"], np.int64), mask=np.frombuffer(row["no_id"], bool))]
                if checksums:
                    raw = ids.astype("<u4").tobytes()
                    crc = [zlib.crc32(memoryview(raw)[4 * (e - n) : 4 * e]) for n, e in zip(lengths.tolist(), ends.tolist(), strict=True)]
                    tail = [pa.array(lengths), pa.array(crc, pa.int64())]
                else:
                    tail = [pa.LargeListArray.from_arrays(pa.array(np.append(0, ends)), pa.array(ids)).cast(pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([*head, *tail], ["part", "seg", "at", "doc", "doc_id", *(["n", "crc32"] if checksums else ["ids"])])

    own = "n long, crc32 long" if checksums else "ids array<int>"
    return spark.read.schema(_SEGMENT).parquet(folder).mapInArrow(lean(run), f"part int, seg int, at long, doc long, doc_id long, {own}")


def starts(spark: SparkSession, folder: str) -> DataFrame:
    """(part, seg, before): ids before each segment, from the segments' sizes alone."""
    sizes = spark.read.schema(_SEGMENT).parquet(folder).select("part", "seg", "n")
    return prefix_sums(sizes, [], [F.col("part"), F.col("seg")], {"before": F.col("n")}, "segments").select("part", "seg", "before")


def joined_crc32(parts: list[tuple[int, int]]) -> int:
    """The crc32 of bytes from those of their pieces, each given as (crc32, number of bytes)."""
    poly, out = 0xEDB88320, 0

    def times(a: int, b: int) -> int:  # modulo the polynomial, bits reversed
        product = 0
        for k in range(31, -1, -1):
            if a >> k & 1:
                product ^= b
            b = b >> 1 ^ (poly if b & 1 else 0)
        return product

    for crc, size in parts:
        shift, power, bits = 1 << 31, 1 << 30, 8 * size
        while bits:
            if bits & 1:
                shift = times(shift, power)
            power, bits = times(power, power), bits >> 1
        out = times(shift, out) ^ crc
    return out


@F.pandas_udf(T.LongType())
def _joined(parts: pd.Series) -> pd.Series:
    return pd.Series([joined_crc32([(p["crc32"], 4 * p["n"]) for p in row]) for row in parts], dtype="int64")


def digest(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from its files.

    A null or empty text has the end id only. Rows that repeat a doc_id are documents of their own,
    ordered by the text's hash and the text. A very long text is spread over segments, whose checksums are joined. Further columns are
    ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write(docs, folder)
    found = read(spark, folder, checksums=True).join(starts(spark, folder), ["part", "seg"]).withColumn("start", F.col("before") + F.col("at"))
    # Only the first and the last document of a segment can go on in another.
    split = (F.col("n") == SEGMENT_IDS) | (F.col("at") == 0) | (F.col("at") + F.col("n") == SEGMENT_IDS)
    found = materialise(found.select("part", "doc", "doc_id", "start", "n", "crc32", split.alias("split")), "token-digests")
    whole = found.where("not split").select("doc_id", "start", F.col("n").alias("n_tokens"), F.col("crc32").alias("ids_crc32"))
    pieces = found.where("split").groupBy("part", "doc").agg(F.min("doc_id").alias("doc_id"), F.min("start").alias("start"), F.sum("n").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("start", "n", "crc32"))).alias("parts"))
    return whole.unionByName(pieces.select("doc_id", "start", "n_tokens", F.when(F.size("parts") == 1, F.col("parts")[0]["crc32"]).otherwise(_joined("parts")).alias("ids_crc32")))
