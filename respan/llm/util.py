"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from respan.session import scratch_path

#: Bytes of one Arrow batch handed to a Python worker: bounds memory when a partition
#: holds many long texts (a single longer row still travels alone).
BATCH_BYTES = 24 * 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession, max_bytes: int = BATCH_BYTES, max_rows: int = 10000) -> None:
    """Bound the Arrow batches of the session by bytes as well as by rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(max_rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(max_bytes))


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` once below the shared checkpoint folder and read it back: cuts the
    lineage with files that survive lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_mod(doc_id, mod: int):
    """crc32 of the document id's decimal text, modulo ``mod`` (a null id counts as
    the empty string)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % F.lit(mod)


def py_crc_mod(doc_id, mod: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % mod


def split_words(b: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 bytes (bytes.split knows the same six)."""
    return b.split()


def rows_to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(cols, schema, strict=True)],
                                      schema=schema)


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit mixing function (vectorised, wraps around)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-grams of a sequence of 64-bit hashes (empty if it is shorter):
    a rolling polynomial modulo 2**64 over an odd base, then mixed."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = _powers(len(h))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up, dtype=np.uint64)])
    return mix64((sums[k:] - sums[:n]) * down[:n] + np.uint64(k))


def span_hashes(h: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The hashes :func:`window_hashes` gives the spans of ``length`` from ``first``."""
    up, down = _powers(len(h))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up, dtype=np.uint64)])
    return mix64((sums[first + length] - sums[first]) * down[first] + length.astype(np.uint64))


class WordHashes(dict):
    """64-bit hashes of words, remembered within a worker (emptied when large)."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        v = xxhash.xxh3_64_intdigest(word)
        if len(self) < 600_000:
            self[word] = v
        return v

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def bitmap(hashes: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bitmap of ``2 ** bits`` bits over a column of 64-bit hashes, whatever their
    number: set words are combined on the executors, so the driver gets 2 ** (bits - 6)
    words at most."""
    at = f"shiftrightunsigned({column}, {64 - bits})"
    words = (hashes.groupBy(F.expr(f"shiftright({at}, 6)").alias("w"))
             .agg(F.expr(f"bit_or(shiftleft(1L, cast({at} & 63 as int)))").alias("v")))
    out = np.zeros(1 << (bits - 6), np.int64)
    for batch in words.toArrow().to_batches():
        out[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return out.view(np.uint64)


def in_bitmap(h: np.ndarray, words: np.ndarray) -> np.ndarray:
    bits = 6 + int(len(words)).bit_length() - 1
    at = h >> np.uint64(64 - bits)
    return (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def batched(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    """Each Arrow batch as Python lists by column name."""
    for b in batches:
        if b.num_rows:
            yield {n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's vocabulary file (installed on every worker)."""
    import public_tokenizers

    return public_tokenizers.path(name)
