"""Token ids in compressed binary files with an index for reading single documents.

Layout of a folder. ``dictionary``: the zstandard dictionary, trained on the
serialized ids of a bounded sample. ``part-NNNNN.ids``: a header (magic,
SHA-256 of the dictionary, bytes of an id) and then one zstandard frame for
each document. ``part-NNNNN.index``: for each document its id, the offset and
length of its frame, its first token within the part and its number of tokens.
Parts follow each other in ascending document id, and so do the documents in a
part; equal ids are in order of their texts, null ids come first.

A task writes under a name of its own attempt and then renames; what it writes
depends on its rows alone, so a second attempt that comes later leaves the first
one's files, which are the same. A very long text is one frame, which one task
holds whole; it is encoded without its length being bounded. An empty table: no parts.
"""
from __future__ import annotations

import hashlib
import io
import os
import posixpath
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netweft.llm.batches import keyed_texts, merged, pieces, sampled
from netweft.llm.files import settle
from netweft.llm.parts import Known, encoded, lists_of
from netweft.plans.scratch import new_folder, passing

MAGIC = b"NWTOKENS"
HEADER = struct.Struct("<8s32sI")
INDEX = np.dtype([("doc_id", "<i8"), ("known", "?"), ("offset", "<u8"), ("length", "<u8"), ("first", "<u8"), ("n_tokens", "<u8")])
#: Documents that the dictionary is trained on, and bytes that it may have.
SAMPLE, DICTIONARY_BYTES = 1_000, 32 << 10
_MARKS, _TOGETHER = b",.;:!?", 1_000
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")


class WordEncoder:
    """A tokenizer of the tokenizers library that drops white space, asked once for each part between blanks.

    Such a tokenizer sees what stands between white space as separate words, so
    the ids of a text are those of its parts, put together. Parts also end
    before those of ``_MARKS`` that the tokenizer sets apart from letters and
    digits. If a word's last token can be told from others, many words of
    letters go through the tokenizer as one text.
    """

    def __init__(self, path: str, held: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.stripped, self.words = Known(self._learn, held), Known(self._strip, held)
        self.marks = bytes(x for x in _MARKS if self._apart(chr(x)))
        ending = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.last = np.zeros(self.vocabulary, bool)
        if ending:
            self.last[[i for x, i in self.tokenizer.get_vocab().items() if x.endswith(ending)]] = True

    def _apart(self, mark: str) -> bool:
        """Whether a mark that follows a letter or a digit begins a word."""
        split = self.tokenizer.pre_tokenizer
        return split is not None and all(any(end == 1 for _, (_, end) in split.pre_tokenize_str(x + mark)) for x in "aZ09")

    def _strip(self, parts: list[str]) -> pa.LargeListArray:
        return self.stripped(pc.utf8_trim(pa.array(parts, pa.large_string()), " \n"))

    def _learn(self, parts: list[str]) -> pa.LargeListArray:
        own: list[list[int]] = [[]] * len(parts)
        alone, words = [], []
        for i, x in enumerate(parts):
            (words if _LETTERS.fullmatch(x) else alone).append(i)
        for k in range(0, len(words), _TOGETHER):
            some = words[k : k + _TOGETHER]
            ids = self.tokenizer.encode_batch_fast([" ".join(parts[i] for i in some)], add_special_tokens=False)[0].ids
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(some):
                alone += some
                continue
            at = 0
            for i, end in zip(some, ends.tolist()):
                own[i] = ids[at:end]
                at = end
        for k in range(0, len(alone), _TOGETHER):
            some = alone[k : k + _TOGETHER]
            for i, e in zip(some, self.tokenizer.encode_batch_fast([parts[i] for i in some], add_special_tokens=False)):
                own[i] = e.ids
        return lists_of([i for ids in own for i in ids], list(map(len, own)))

    def encode(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        """The ids of each text."""
        ids, first = encoded(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), self.words, self.marks)
        return [ids[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist())]


_made: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One for each Python process, whatever the number of tasks."""
    if path not in _made:
        _made[path] = WordEncoder(path)
    return _made[path]


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary, or where there is too little to train on, the samples' own first bytes."""
    samples = [x for x in samples if x]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


class _Part:
    """The files of one part while they are written."""

    def __init__(self, folder: str, name: str, attempt: str, dictionary: bytes, width: int):
        self.store, base = fs.FileSystem.from_uri(folder)
        self.final = {x: posixpath.join(base, f"{name}.{x}") for x in ("ids", "index")}
        self.draft = {x: f"{p}.{attempt}.draft" for x, p in self.final.items()}
        self.store.create_dir(base, recursive=True)
        self.out = self.store.open_output_stream(self.draft["ids"])
        self.out.write(HEADER.pack(MAGIC, hashlib.sha256(dictionary).digest(), width))
        self.pack = zstandard.ZstdCompressor(level=3, dict_data=_dictionary(dictionary))
        self.at, self.tokens, self.index, self.width = HEADER.size, 0, [], width

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        n = len(ids)
        frame = self.pack.compress(ids.astype(f"<u{self.width}").tobytes())
        self.out.write(frame)
        self.index.append((doc_id or 0, doc_id is not None, self.at, len(frame), self.tokens, n))
        self.at += len(frame)
        self.tokens += n

    def close(self) -> None:
        self.out.close()
        with self.store.open_output_stream(self.draft["index"]) as out:
            out.write(np.array(self.index, INDEX).tobytes())
        for x, p in self.draft.items():
            settle(self.store, p, self.final[x])


def write(
    docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int | None = 2, sample: int = SAMPLE
) -> DataFrame:
    """Encodes whole texts and writes ``folder``; returns its manifest (part, path, n_docs, n_tokens, base).

    base: the number of tokens in all parts before. The rows are dealt out by
    ranges of the key before they are encoded, so encoding is done once. The
    manifest is a table in the folder, with one row for each part. A null or
    empty text has no ids but ``end_id``. An empty table: no parts.
    """
    spark = docs.sparkSession
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    rows = keyed_texts(docs, key, text)
    ending = np.array([] if end_id is None else [end_id], np.uint32)
    mine = WordEncoder(path)
    width = 2 if max(mine.vocabulary, (end_id or 0) + 1) <= 1 << 16 else 4
    samples = [np.append(x, ending).astype(f"<u{width}").tobytes() for x in mine.encode([r.text for r in sampled(rows, sample).collect()])]
    dictionary = train_dictionary(samples)
    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    with store.open_output_stream(posixpath.join(base, "dictionary")) as out:
        out.write(dictionary)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, e, part = TaskContext.get(), encoder(path), None
        name = f"part-{task.partitionId():05d}"
        for some in pieces(merged(batches, 6 << 20), limit=8 << 20):
            if part is None:
                part = _Part(folder, name, str(task.taskAttemptId()), dictionary, width)
            for doc_id, ids in zip(some.column("key").to_pylist(), e.encode(some.column("text"))):
                part.add(doc_id, np.append(ids, ending))
        if part:
            part.close()
            yield pa.RecordBatch.from_pydict(
                {"part": [task.partitionId()], "path": [f"{folder}/{name}"], "n_docs": [len(part.index)], "n_tokens": [part.tokens]},
                pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]),
            )

    schema = "part int, path string, n_docs long, n_tokens long"
    rows.repartitionByRange("key").sortWithinPartitions("key", "text").mapInArrow(mapped, schema).write.parquet(f"{folder}/manifest")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The parts of a folder with their bases; as many rows as there are parts."""
    parts = spark.read.schema("part int, path string, n_docs long, n_tokens long").parquet(f"{folder}/manifest")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return parts.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


class Reader:
    """Documents of one part, all in turn or one by its id."""

    def __init__(self, path: str):
        self.store, self.base = fs.FileSystem.from_uri(path)
        with self.store.open_input_stream(posixpath.join(posixpath.dirname(self.base), "dictionary")) as f:
            dictionary = f.read()
        self.file = self.store.open_input_file(f"{self.base}.ids")
        magic, digest, self.width = HEADER.unpack(self.file.read_at(HEADER.size, 0))
        if magic != MAGIC or digest != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{path} was not written with the dictionary beside it")
        self.unpack = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))
        with self.store.open_input_stream(f"{self.base}.index") as f:
            self.index = np.frombuffer(f.read(), INDEX)

    def _ids(self, frame: bytes) -> np.ndarray:
        return np.frombuffer(self.unpack.decompress(frame), f"<u{self.width}").astype("<u4")

    def document(self, doc_id: int) -> np.ndarray:
        """The ids of the first document of that id: one frame is read."""
        at = np.flatnonzero((self.index["doc_id"] == doc_id) & self.index["known"])
        if not len(at):
            raise KeyError(doc_id)
        row = self.index[at[0]]
        return self._ids(self.file.read_at(int(row["length"]), int(row["offset"])))

    def __iter__(self) -> Iterator[tuple[np.void, np.ndarray]]:
        with self.store.open_input_stream(f"{self.base}.ids") as raw, io.BufferedReader(raw, 1 << 20) as f:
            f.read(HEADER.size)
            for row in self.index:
                yield row, self._ids(f.read(int(row["length"])))


def read(parts: DataFrame, digest: Callable[[np.ndarray], int]) -> DataFrame:
    """(doc_id, start, n_tokens, digest) of every document in the files of a manifest; start counts from its base."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                rows: list[tuple] = []
                for row, ids in Reader(path):
                    rows.append((int(row["doc_id"]) if row["known"] else None, base + int(row["first"]), int(row["n_tokens"]), digest(ids)))
                    if len(rows) == 10_000:
                        yield _rows(rows)
                        rows = []
                yield _rows(rows)

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["doc_id", "start", "n_tokens", "digest"])

    n = max(1, parts.count())
    return parts.select("path", "base").repartition(n).mapInArrow(mapped, "doc_id long, start long, n_tokens long, digest long")


def ids_crc32(ids: np.ndarray) -> int:
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the ids of whole ``documents`` to files and returns what the files hold."""
    parts = write(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder := new_folder(spark, "tokens"))
    passing(spark, folder)
    return read(parts, ids_crc32).withColumnRenamed("digest", "ids_crc32")
