"""Token ids of documents in binary files of patched frame-of-reference blocks.

:func:`encode` gives the ids of every text, :func:`write_ids` writes them in ascending
document order as a folder of files (format ``pfor``, a Spark data source), and
:func:`read_ids` reads such a folder.  A file is

    magic | blocks (see ``pfor``) | block starts u64 | document ids i64 | null flags u8 |
    tokens of each document u64 | blocks, documents, tokens, end of the blocks (u64 each) | magic

Block starts make every token of a file reachable without reading what lies before it
(:func:`read_span`).  A task writes one file under a name of its own attempt; the driver
lists the files of the attempts that Spark committed in ``manifest.json``, with the number of
tokens before each, so files of lost or repeated attempts are never read.

Ids come from the ``tokenizers`` library.  A byte-level vocabulary never joins text across a
space that is followed by a non-space, so words are encoded once by the library's model and
remembered; a text with a special token's string and words beyond Latin letters go through
the library's whole encoder.  Tests hold the ids equal to plain ``encode`` calls.

Defined cases: a null text is empty and has its end token only; an empty table gives a folder
without files and no rows; rows with a null id come first; equal ids are ordered by a hash of
the text, and equal rows, which nothing tells apart, are spread over files by a running number;
a text is one row and must fit a task, its blocks do not depend on its length; extra columns
are ignored.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from respan.llm import pfor
from respan.llm.util import batched, bound_batches
from respan.session import scratch_path

MAGIC = b"RSPFOR01"
FOOT = struct.Struct("<QQQQ8s")
#: Blocks encoded or decoded at a time.
CHUNK = 1024
#: Text bytes that a file aims at; smaller inputs are cut finer, down to LEAST bytes, to keep all cores busy.
FILE_BYTES, LEAST = 192 << 20, 8 << 20
#: Words, and matches of the pattern, that a worker remembers (about 180 bytes each); emptied when full.
MEMORY = 700_000
#: Bytes of ids in one batch of rows read.
READ_BYTES = 8 << 20


# ---------------------------------------------------------------- encoding
class LibraryIds(dict):
    """Ids (bytes) of words with one space before them, by the library's own model; words, and the
    matches of the pre-tokeniser's pattern that they consist of, are encoded when first met."""

    def __init__(self, tokenizer):
        import regex

        import public_tokenizers

        super().__init__()
        self.tokenizer, self.model = tokenizer, tokenizer.model.tokenize
        special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(map(regex.escape, special)) or "(?!)").search
        self.far = regex.compile("[^\x00-\u024f]").search
        self.blank = regex.compile(r" (?!\S)").search
        self.find = regex.compile(public_tokenizers.PATTERN).findall
        # the byte-level alphabet: bytes that print stand for themselves, the others from 256 on
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        rest = [b for b in range(256) if b not in plain]
        self.alphabet = {b: 256 + i for i, b in enumerate(rest)}
        self.pieces: dict[str, bytes] = {}

    def unit(self, piece: str) -> bytes:
        """Ids of one match of the pre-tokeniser's pattern."""
        v = self.pieces.get(piece)
        if v is None:
            if piece[0] == " " and piece.isascii() and piece[1:].isalpha():
                line = "\u0120" + piece[1:]
            else:
                line = piece.encode().decode("latin-1").translate(self.alphabet)
            if len(self.pieces) >= MEMORY:
                self.pieces.clear()
            v = self.pieces[piece] = array("I", [t.id for t in self.model(line)]).tobytes()
        return v

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a text without a special token's string."""
        if not text.isascii() and self.far(text):
            return self.whole(text)
        return b"".join(map(self.unit, self.find(text)))

    def __missing__(self, word: str) -> bytes:
        if word.isalpha() and (word.isascii() or not self.far(word)):
            v = self.unit(" " + word)
        elif word[:-1].isalpha() and word[-1] in ".,;:!?" and (word.isascii() or not self.far(word)):
            v = self.unit(" " + word[:-1]) + self.unit(word[-1])
        else:
            v = self.encode(" " + word)
        if len(self) >= MEMORY:
            self.clear()
        self[word] = v
        return v

    def ids(self, text: str) -> bytes:
        if self.special(text):
            return self.whole(text)
        parts = text.split(" ")
        if self.blank(text):  # a space before white space or the end joins what follows
            merged = [parts[0]]
            for p in parts[1:]:
                if p and not p[0].isspace():
                    merged.append(p)
                else:
                    merged[-1] += " " + p
            parts = merged
        return self.encode(parts[0]) + b"".join(map(self.__getitem__, parts[1:]))


_IDS: dict[str, LibraryIds] = {}


def library_ids(path: str) -> LibraryIds:
    """The worker's encoder of a vocabulary file (made once a process)."""
    if path not in _IDS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _IDS[path] = LibraryIds(Tokenizer.from_file(path))
    return _IDS[path]


def ordered(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) in ascending document order, one range of documents a partition.

    The number of ranges grows with the bytes of the texts."""
    size = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    cores = docs.sparkSession.sparkContext.defaultParallelism
    files = max(-(-size // FILE_BYTES), min(2 * cores, -(-size // LEAST)), 1)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text")).withColumn("number", F.monotonically_increasing_id())
    by = ["doc_id", "hash", "number"]
    return rows.repartitionByRange(int(files), *by).sortWithinPartitions(*by).select("doc_id", "text")


def encode(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """(doc_id, ids): little-endian unsigned 32-bit ids of every (doc_id, text) row, then ``end_id``."""
    bound_batches(docs.sparkSession, 8 << 20)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = library_ids(tokenizer_path)
        end = struct.pack("<I", end_id)
        for cols in batched(batches):
            ids = [words.ids(t or "") + end for t in cols["text"]]
            yield pa.RecordBatch.from_arrays([pa.array(cols["doc_id"], pa.int64()), pa.array(ids, pa.binary())], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary")


# ---------------------------------------------------------------- files
def store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI that the driver and all executors reach."""
    if "://" in path and not path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")


@dataclass
class Written(WriterCommitMessage):
    partition: int
    name: str
    documents: int
    tokens: int


class FileWriter:
    """One file: ids are taken document by document, whole blocks go out in chunks."""

    def __init__(self, out):
        self.out, self.at, self.rest = out, len(MAGIC), []
        self.waiting, self.tokens, self.starts, self.docs, self.counts = 0, 0, [], [], []
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.counts.append(len(ids))
        self.tokens += len(ids)
        self.rest.append(ids)
        self.waiting += len(ids)
        if self.waiting >= CHUNK * pfor.BLOCK:
            ids = np.concatenate(self.rest)
            whole = len(ids) // pfor.BLOCK * pfor.BLOCK
            for a in range(0, whole, CHUNK * pfor.BLOCK):
                self.blocks(ids[a:min(a + CHUNK * pfor.BLOCK, whole)])
            self.rest, self.waiting = [ids[whole:]], len(ids) - whole

    def blocks(self, ids: np.ndarray) -> None:
        data, start = pfor.encode_blocks(ids)
        self.out.write(data)
        self.starts.append(start + self.at)
        self.at += len(data)

    def close(self) -> None:
        if self.waiting:
            self.blocks(np.concatenate(self.rest))
        starts = np.concatenate([*self.starts, np.zeros(0, np.int64)])
        self.out.write(starts.astype("<u8").tobytes())
        self.out.write(np.array([d or 0 for d in self.docs], "<i8").tobytes())
        self.out.write(np.array([d is None for d in self.docs], np.uint8).tobytes())
        self.out.write(np.array(self.counts, "<u8").tobytes())
        self.out.write(FOOT.pack(len(starts), len(self.docs), self.tokens, self.at, MAGIC))


class FileIndex:
    """Block starts and documents of a file (an open seekable input)."""

    def __init__(self, source):
        self.source = source
        source.seek(source.size() - FOOT.size)
        blocks, documents, self.tokens, self.end, magic = FOOT.unpack(source.read(FOOT.size))
        if magic != MAGIC:
            raise ValueError("not a file of token-id blocks, or cut off")
        source.seek(self.end)
        raw = source.read(8 * blocks + 17 * documents)
        self.starts = np.append(np.frombuffer(raw, "<u8", blocks), self.end).astype(np.int64)
        self.docs = np.frombuffer(raw, "<i8", documents, 8 * blocks)
        self.null = np.frombuffer(raw, np.uint8, documents, 8 * blocks + 8 * documents) != 0
        self.counts = np.frombuffer(raw, "<u8", documents, 8 * blocks + 9 * documents).astype(np.int64)

    def ids(self, first: int, last: int) -> np.ndarray:
        """The ids of blocks ``first`` to ``last`` (exclusive), without the filling of the last."""
        self.source.seek(int(self.starts[first]))
        data = self.source.read(int(self.starts[last] - self.starts[first]))
        ids = pfor.decode_blocks(data, self.starts[first:last] - self.starts[first])
        return ids[:self.tokens - first * pfor.BLOCK]


def read_span(path: str, start: int, length: int) -> np.ndarray:
    """Ids ``start`` to ``start + length`` of one file, reading their blocks only."""
    fs, name = store(path)
    with fs.open_input_file(name) as source:
        index = FileIndex(source)
        length = max(min(length, index.tokens - start), 0)
        first, last = start // pfor.BLOCK, -(-(start + length) // pfor.BLOCK)
        if not length:
            return np.zeros(0, np.uint32)
        return index.ids(first, last)[start - first * pfor.BLOCK:][:length]


class _Writer(DataSourceArrowWriter):
    """Writes (doc_id, ids), or (doc_id, text) that the task encodes itself."""

    def __init__(self, path: str, tokenizer: str | None, end_id: int):
        self.path, self.tokenizer, self.end = path, tokenizer, struct.pack("<I", end_id)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, folder = store(self.path)
        fs.create_dir(folder, recursive=True)
        name = f"part-{task.partitionId():06d}-{uuid.uuid4().hex}.pfor"
        with fs.open_output_stream(f"{folder}/{name}") as out:
            file = FileWriter(out)
            words = library_ids(self.tokenizer) if self.tokenizer else None
            for batch in iterator:
                for doc, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    ids = words.ids(v.as_py() or "") + self.end if words is not None else v.as_buffer()
                    file.add(doc, np.frombuffer(ids, "<u4"))
            file.close()
        return Written(task.partitionId(), name, len(file.docs), file.tokens)

    def commit(self, messages: list[WriterCommitMessage]) -> None:
        files, before = [], 0
        for m in sorted((m for m in messages if m is not None), key=lambda m: m.partition):
            if m.documents:
                files.append({"name": m.name, "documents": m.documents, "tokens": m.tokens, "before": before})
                before += m.tokens
        fs, folder = store(self.path)
        fs.create_dir(folder, recursive=True)
        with fs.open_output_stream(f"{folder}/manifest.json") as out:
            out.write(json.dumps({"files": files}).encode())

    def abort(self, messages: list[WriterCommitMessage]) -> None:
        fs, folder = store(self.path)
        for m in messages:
            if m is not None:
                fs.delete_file(f"{folder}/{m.name}")


@dataclass
class _Part(InputPartition):
    name: str
    before: int


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        fs, folder = store(self.path)
        with fs.open_input_file(f"{folder}/manifest.json") as source:
            return [_Part(f["name"], f["before"]) for f in json.loads(source.read())["files"]]

    def read(self, partition: _Part | None) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, _Part):  # a folder without files is read as one empty partition
            return
        fs, folder = store(self.path)
        with fs.open_input_file(f"{folder}/{partition.name}") as source:
            index = FileIndex(source)
            start = np.concatenate([[0], np.cumsum(index.counts)])
            buffer, at, doc = bytearray(), 0, 0  # ids from number ``at`` on
            for b in range(0, len(index.starts) - 1, CHUNK):
                buffer += index.ids(b, min(b + CHUNK, len(index.starts) - 1)).astype("<u4", copy=False).tobytes()
                while doc < len(index.docs) and 4 * (start[doc + 1] - at) <= len(buffer):
                    limit = np.searchsorted(start, at + min(len(buffer), READ_BYTES) // 4, "right") - 1
                    last = max(int(limit), doc + 1)
                    edges = [int(x) for x in 4 * (start[doc:last + 1] - at)]
                    ids = [bytes(buffer[x:y]) for x, y in zip(edges, edges[1:], strict=False)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(index.docs[doc:last], pa.int64(), mask=index.null[doc:last]),
                         pa.array(start[doc:last] + partition.before, pa.int64()),
                         pa.array(index.counts[doc:last], pa.int64()), pa.array(ids, pa.binary())],
                        names=["doc_id", "start", "n_tokens", "ids"])
                    del buffer[:edges[-1]]
                    at, doc = int(start[last]), last


class TokenIdFiles(DataSource):
    """Data source ``pfor``: written from (doc_id, ids), or from (doc_id, text) with the option
    ``tokenizer`` (and ``endId``), read as (doc_id, start, n_tokens, ids)."""

    @classmethod
    def name(cls) -> str:
        return "pfor"

    def schema(self) -> str:
        return "doc_id long, start long, n_tokens long, ids binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], self.options.get("tokenizer"), int(self.options.get("endid", 0)))


def write_ids(rows: DataFrame, path: str, **options) -> None:
    """Write (doc_id, ids) rows, whose partitions are ranges in document order, to a new folder
    (rows of (doc_id, text) with the options of :class:`TokenIdFiles`)."""
    rows.sparkSession.dataSource.register(TokenIdFiles)
    bound_batches(rows.sparkSession, 8 << 20, 1000)
    rows.write.format("pfor").mode("append").options(**options).save(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of a folder; ``start`` counts the ids of all documents before."""
    spark.dataSource.register(TokenIdFiles)
    return spark.read.format("pfor").load(path)


def through_files(docs: DataFrame, tokenizer_path: str, path: str | None = None) -> DataFrame:
    """Encode ``documents``, write the files (by default below the shared folder), read them back."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, f"token-ids-{uuid.uuid4().hex}")
    write_ids(ordered(docs), path, tokenizer=tokenizer_path)
    return read_ids(spark, path)
