"""Substring deduplication by a join of word windows in blocks.

It stands in place of a relative Lempel-Ziv parse (see README): no document is factored; "phrase" and
"factor" below mean runs of windows that a document with a smaller id has.  The reference
is indexed in *blocks*: each window of :data:`WINDOW` words has an anchor, its least
:data:`GRAM`-gram hash, and the consecutive windows with one anchor form a block of up to
``WINDOW - GRAM + 1`` windows.  Equal passages fall into equal blocks, whatever stands around them.

* A block that occurs whole in an earlier document is a phrase copied from there;
  neighbouring phrases grow into one factor.
* Blocks at the boundaries of a factor differ from the reference's in part.  There each
  window is looked up by itself among all blocks with the same anchor.

A window found in an earlier document marks all its words; the marked runs are the
duplicate spans.  So a factor becomes a span exactly if it has WINDOW words or more.

Scale: blocks, not words, move.  Anchors seen in one document only are left out by a
bitmap of fixed size (it can only let too many pass); block keys are pre-aggregated to
their smallest document, so a passage shared by a third of all documents is one row a
task; answers are joined back on keys that adaptive execution may split.

Defined cases: null text has no words; a null doc_id counts as larger than any; equal ids
are not smaller than each other, so repeated rows are answered alike and none removes
the other; texts below WINDOW words stay; extra columns are ignored; empty tables give no
rows.  Equality of windows is that of 96 hash bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from respan.llm.util import (WordHashes, batched, bitmap, bound_batches, in_bitmap, split_words, stored,
                             window_hashes)

WINDOW, GRAM = 13, 5
#: Size of both bitmaps: 2 ** 27 bits, 16 MB.
BITS = 27
NO_ID = (1 << 63) - 1


def blocks(h: np.ndarray, window: int = WINDOW, gram: int = GRAM):
    """Blocks of a sequence of word hashes: (anchor hash, first window, number of windows)."""
    g = window_hashes(h, gram)
    n = len(h) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    best, at = g[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, window - gram + 1):
        x = g[j:j + n]
        less = x < best
        best[less] = x[less]
        at[less] = j
    at += np.arange(n)
    first = np.flatnonzero(np.r_[True, np.diff(at) != 0])
    return best[first], first, np.diff(np.r_[first, n])


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Key of a row (id and text), comparable id, text as bytes."""
    raw = F.col(text).cast("binary")
    d = F.col(doc_id).cast("long")
    return docs.select(F.xxhash64(d, raw).alias("key"), F.coalesce(d, F.lit(NO_ID)).alias("doc"), raw.alias("t"))


def _anchors(rows: DataFrame, window: int, gram: int) -> DataFrame:
    schema = pa.schema([("anchor", pa.int64()), ("doc", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for cols in batched(batches):
            hs, ds = [], []
            for d, t in zip(cols["doc"], cols["t"], strict=True):
                a = np.unique(blocks(memo.of(split_words(t or b"")), window, gram)[0])
                hs.append(a)
                ds.append(np.full(len(a), d, np.int64))
            if hs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs).view(np.int64)),
                                                  pa.array(np.concatenate(ds))], schema=schema)

    return rows.select("doc", "t").mapInArrow(run, "anchor long, doc long")


def _occurrences(rows: DataFrame, shared, window: int, gram: int) -> DataFrame:
    """Blocks whose anchor the bitmap ``shared`` (a broadcast) has."""
    schema = pa.schema([("anchor", pa.int64()), ("block", pa.int64()), ("key", pa.int64()), ("doc", pa.int64()),
                        ("start", pa.int32()), ("prints", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, words_map = WordHashes(), shared.value
        for cols in batched(batches):
            out: list[list] = [[] for _ in schema]
            for key, d, t in zip(cols["key"], cols["doc"], cols["t"], strict=True):
                h = memo.of(split_words(t or b""))
                anchor, first, count = blocks(h, window, gram)
                use = np.flatnonzero(in_bitmap(anchor, words_map))
                if not len(use):
                    continue
                first, count = first[use], count[use]
                prints = window_hashes(h, window).astype("<u4")  # the anchor adds 64 bits
                # identity of a block: number of windows, its first and last window
                last = first + count - 1
                block = (prints[first].astype(np.int64) << 32 | prints[last].astype(np.int64))
                out[0].append(anchor[use].view(np.int64))
                out[1].append(block ^ count)
                out[2].append(np.full(len(use), key, np.int64))
                out[3].append(np.full(len(use), d, np.int64))
                out[4].append(first.astype(np.int32))
                raw = prints.tobytes()
                out[5] += [raw[4 * a:4 * (a + c)] for a, c in zip(first.tolist(), count.tolist(), strict=True)]
            arrays = [pa.array(np.concatenate(c), f.type) if c else pa.array([], f.type)
                      for c, f in zip(out[:5], list(schema)[:5], strict=True)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(out[5], pa.binary())], schema=schema)

    return rows.mapInArrow(run, "anchor long, block long, key long, doc long, start int, prints binary")


def _boundary_masks(block: DataFrame) -> DataFrame:
    """(anchor, block, mask): windows of a block that an earlier document has in another
    block with the same anchor.  Only anchors with several blocks can have any."""
    several = (block.groupBy("anchor").agg(F.min("block").alias("lo"), F.max("block").alias("hi"))
               .where("lo != hi").select("anchor"))
    count = F.expr("cast(octet_length(prints) / 4 as int)")
    window = (block.join(several, "anchor")
              .select("anchor", "block", "least", "prints", F.explode(F.sequence(F.lit(0), count - 1)).alias("i"))
              .select("anchor", "block", "least", "i", F.expr("substring(prints, 4 * i + 1, 4)").alias("print")))
    window = stored(window, "substring-windows")
    first = window.groupBy("anchor", "print").agg(F.min("least").alias("earliest"))
    return (window.join(first, ["anchor", "print"]).where("earliest < least")
            .groupBy("anchor", "block").agg(F.expr("bit_or(shiftleft(1, i))").alias("mask")))


def duplicate_windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW,
                      gram: int = GRAM) -> DataFrame:
    """(doc, key, start, mask): window ``start + i`` of the row (doc, key) is a duplicate if
    bit ``i`` of ``mask`` is set; blocks without any are left out."""
    spark = docs.sparkSession
    bound_batches(spark, 6 * 1024 * 1024)
    rows = _rows(docs, doc_id, text)
    seen = (_anchors(rows, window, gram).groupBy("anchor").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"))
            .where("lo < hi").select("anchor"))
    shared = spark.sparkContext.broadcast(bitmap(seen, "anchor", BITS))
    found = stored(_occurrences(rows, shared, window, gram), "substring-blocks")
    block = stored(found.groupBy("anchor", "block").agg(F.min("doc").alias("least"), F.first("prints").alias("prints")),
                   "substring-reference")
    masks = _boundary_masks(block)
    known = (block.join(masks, ["anchor", "block"], "left")
             .select("anchor", "block", "least", F.coalesce("mask", F.lit(0)).alias("mask")))
    whole = F.expr("cast(shiftleft(1, cast(octet_length(prints) / 4 as int)) - 1 as int)")
    return (found.join(known, ["anchor", "block"])
            .select("doc", "key", "start", F.when(F.col("doc") > F.col("least"), whole).otherwise(F.col("mask")).alias("mask"))
            .where("mask != 0"))


def covered(n: int, starts: list[int], masks: list[int], window: int = WINDOW) -> np.ndarray:
    """Which of ``n`` words a duplicate window covers."""
    edge = np.zeros(n + 1, np.int64)
    s, m = np.asarray(starts, np.int64), np.asarray(masks, np.int64)
    for i in range(int(m.max()).bit_length() if len(m) else 0):
        at = s[(m >> i) & 1 == 1] + i
        np.add.at(edge, at, 1)
        np.add.at(edge, at + window, -1)
    return np.cumsum(edge[:-1]) > 0


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW,
                with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept_text, spans]) of every row; spans
    are pairs of word numbers, end exclusive.  Texts without a duplicate are answered
    where they are read; only the others meet their spans in a shuffle."""
    spark = docs.sparkSession
    hits = stored(duplicate_windows(docs, doc_id, text, window).groupBy("doc", "key").agg(
        F.collect_list(F.struct("start", "mask")).alias("hits")), "substring-spans")
    touched = spark.sparkContext.broadcast(bitmap(hits.select("key"), "key", BITS))
    rows = _rows(docs, doc_id, text)
    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
    ddl = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    if with_text:
        fields += [("kept_text", pa.string()), ("spans", pa.string())]
        ddl += ", kept_text string, spans string"
    schema = pa.schema(fields)

    def answer(d: int, t: bytes | None, hit: list | None) -> tuple:
        words = split_words(t or b"")
        gone = covered(len(words), [x["start"] for x in hit or ()], [x["mask"] for x in hit or ()], window)
        removed = int(gone.sum())
        kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if removed else words)
        row = (None if d == NO_ID else d, len(words), removed, hashlib.sha256(kept).hexdigest())
        if with_text:
            edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8))).tolist()
            row += (kept.decode(), ",".join(f"{a}:{b}" for a, b in zip(edges[::2], edges[1::2], strict=True)))
        return row

    def to_batch(out: list[tuple]) -> pa.RecordBatch:
        cols = zip(*out, strict=True) if out else [[] for _ in schema]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_map = touched.value
        for cols in batched(batches):
            maybe = in_bitmap(np.array(cols["key"], np.int64).view(np.uint64), words_map).tolist()
            yield to_batch([answer(d, t, None) for d, t, m in zip(cols["doc"], cols["t"], maybe, strict=True) if not m])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_map = touched.value
        for b in batches:
            yield b.filter(pa.array(in_bitmap(b.column(0).to_numpy().view(np.uint64), words_map)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in batched(batches):
            yield to_batch([answer(*x) for x in zip(cols["doc"], cols["t"], cols["hits"], strict=True)])

    picked = rows.mapInArrow(pick, "key long, doc long, t binary")
    marked = picked.join(hits, ["doc", "key"], "left").select("doc", "t", "hits").mapInArrow(cut, ddl)
    return rows.mapInArrow(untouched, ddl).unionByName(marked)
