"""SimHash near-duplicates by Golay-code fuzzy hashing.

Fingerprint (64 bits): the text with A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, all
k-word shingles (repeats included) joined by a space; a bit is 1 if it is set in over
half of the shingles' XXH64 values (seed 42).

Links (at most 3 differing bits) are found without comparing all pairs.  The 64 bits are
cut into three segments (22, 21, 21 bits).  Three errors leave either one segment without
error and another with one at most, or exactly one error in each:

* ``exact x Golay``: for each ordered pair of segments the bits of the first with every
  Golay index of the second;
* ``Golay x Golay x Golay``: an index of every segment.  A word takes all its indices in
  the first segment with its own index in the others, and the reverse; words one bit
  apart in each segment meet, since the own index of one is among all indices of the other.

Distinct fingerprints (never documents) are joined on these keys.  A bucket is walked by
breadth-first search over those not yet reached, every link verified on the 64 bits, and
gives a spanning forest of its links, not its pairs.  Components come from alternating
minimum labels with pointer jumping on DataFrames, each round written to the shared folder.

Defined cases: null and empty texts and those without a word have fingerprint 0, linked like any
other; a text with fewer words is one shingle; equal fingerprints are one component;
repeated rows give repeated rows; a null doc_id is never the smallest unless alone (its
component is null then); extra columns are ignored; an empty table gives no rows; long
texts are hashed block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from respan.llm import golay
from respan.llm.util import batched, bitmap, bound_batches, in_bitmap, split_words, stored

MAX_BITS = 3
SHINGLE = 3
#: (shift, width) of the three segments.
SEGMENTS = ((42, 22), (21, 21), (0, 21))
#: Shingles whose bits are counted at a time.
BLOCK = 1 << 15


def fingerprint(text: bytes, k: int = SHINGLE) -> int:
    """SimHash of a UTF-8 text."""
    import xxhash

    words = split_words(text.lower())  # bytes.lower changes A-Z only
    if not words:
        return 0
    n = max(len(words) - k + 1, 1)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])[:n].tolist()
    ends = (ends[min(k, len(words)) - 1:] - 1).tolist()
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, n, BLOCK):
        h = np.array([digest(line[a:b], 42) for a, b in zip(starts[i:i + BLOCK], ends[i:i + BLOCK], strict=True)],
                     np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for j in range(0, len(bits), 255):  # sums of 255 bits fit a byte, which is fast
            counts += bits[j:j + 255].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, key, fp): ``key`` is a hash of id and text, ``fp`` the 64 bits as a long."""
    bound_batches(docs.sparkSession, 8 * 1024 * 1024)
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in batched(batches):
            fp = np.array([fingerprint(t or b"", shingle) for t in cols["t"]], np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(cols["d"], pa.int64()), pa.array(cols["key"], pa.int64()),
                                              pa.array(fp.view(np.int64))], schema=schema)

    d, raw = F.col(doc_id).cast("long"), F.col(text).cast("binary")
    rows = docs.select(d.alias("d"), F.xxhash64(d, raw).alias("key"), raw.alias("t"))
    return rows.mapInArrow(run, "doc_id long, key long, fp long")


def bucket_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all join keys of 64-bit fingerprints."""
    seg = [(fp >> np.uint64(s)).astype(np.int64) & ((1 << w) - 1) for s, w in SEGMENTS]
    every = [golay.keys(s) for s in seg]
    own = [golay.decode(s) for s in seg]
    rows, keys = [], []

    def add(kind: int, high: np.ndarray, low: np.ndarray, valid: np.ndarray) -> None:
        key = (np.int64(kind) << np.int64(48)) | (high << np.int64(24)) | low
        rows.append(np.nonzero(valid)[0])
        keys.append(key[valid])

    kind = 0
    for i in range(3):
        for j in range(3):
            if i != j:
                e = every[j]
                add(kind, np.broadcast_to(seg[i][:, None], e.shape), e, e >= 0)
                kind += 1
    e0, e1, e2 = every
    add(kind, e0, np.broadcast_to(((own[1] << 12) | own[2])[:, None], e0.shape), e0 >= 0)
    low = (e1[:, :, None] << 12) | e2[:, None, :]
    add(kind, np.broadcast_to(own[0][:, None, None], low.shape), low, (e1 >= 0)[:, :, None] & (e2 >= 0)[:, None, :])
    return np.concatenate(rows), np.concatenate(keys)


def forest(fp: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the graph "at most ``max_bits`` apart" over distinct
    fingerprints: each reached one is compared with those not reached yet."""
    left, a, b = np.sort(fp), [], []
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            at = todo.pop()
            near = np.bitwise_count(left ^ at) <= max_bits
            if near.any():
                a.append(np.full(int(near.sum()), at, np.uint64))
                b.append(left[near])
                todo.extend(left[near])
                left = left[~near]
    none = np.empty(0, np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b) links between distinct fingerprints (column ``fp``), enough to connect all
    that are within ``max_bits`` (at most 3) of each other."""
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"max_bits must be 0 to {MAX_BITS}: the keys cover no more errors")
    key_schema = pa.schema([("key", pa.int64()), ("fp", pa.int64())])
    link_schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for i in range(0, len(fp), 4096):
                part = fp[i:i + 4096]
                row, key = bucket_keys(part)
                # one row a key and fingerprint
                order = np.lexsort((key, row))
                row, key = row[order], key[order]
                keep = np.r_[True, (np.diff(row) != 0) | (np.diff(key) != 0)] if len(row) else np.empty(0, bool)
                yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(part[row[keep]].view(np.int64))],
                                                 schema=key_schema)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key; a key's rows may span batches."""
        rest_k, rest_f = np.empty(0, np.int64), np.empty(0, np.int64)

        def done(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            a, b = [], []
            at = np.flatnonzero(np.r_[True, np.diff(k) != 0, True]) if len(k) else np.zeros(1, np.int64)
            size = np.diff(at)
            two = at[:-1][size == 2]  # most buckets with company: one comparison
            x, y = f[two].view(np.uint64), f[two + 1].view(np.uint64)
            near = np.bitwise_count(x ^ y) <= max_bits
            a.append(x[near])
            b.append(y[near])
            for i in np.flatnonzero(size > 2):
                p, q = forest(f[at[i]:at[i + 1]].view(np.uint64), max_bits)
                a.append(p)
                b.append(q)
            a, b = np.concatenate(a), np.concatenate(b)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))],
                                              schema=link_schema)

        for batch in batches:
            k = np.concatenate([rest_k, batch.column(0).to_numpy(zero_copy_only=False)])
            f = np.concatenate([rest_f, batch.column(1).to_numpy(zero_copy_only=False)])
            if not len(k):
                continue
            cut = int(np.searchsorted(k, k[-1]))  # the last key may go on
            if cut:
                yield done(k[:cut], f[:cut])
            rest_k, rest_f = k[cut:], f[cut:]
        yield done(rest_k, rest_f)

    keyed = fps.select("fp").mapInArrow(emit, "key long, fp long")
    # a key with one fingerprint has no link; counting is pre-aggregated
    return (keyed.repartition("key").sortWithinPartitions("key").mapInArrow(walk, "a long, b long")
            .distinct())


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b): the smallest node reachable.

    Each round a node takes the least label of its neighbours, then the label of its
    label (pointer jumping), until nothing changes; every round is written once."""
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))),
                  f"{name}-edges")
    labels = stored(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label"))
                    .select(F.col("a").alias("node"), "label"), f"{name}-0")
    turn = 0
    while True:
        turn += 1
        near = (both.join(labels.select(F.col("node").alias("b"), "label"), "b")
                .groupBy("a").agg(F.min("label").alias("near")))
        lower = (labels.join(near.select(F.col("a").alias("node"), "near"), "node", "left")
                 .select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")))
        lower = stored(lower, f"{name}-{turn}-low")
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("next"))
        labels = stored(lower.join(jump, "label", "left")
                        .select("node", "old", F.least("label", F.coalesce("next", "label")).alias("label")),
                        f"{name}-{turn}")
        if labels.where(F.col("label") != F.col("old")).isEmpty():
            return labels.select("node", F.col("label").alias("component"))


def _component_of_fingerprint(rows: DataFrame, max_bits: int) -> DataFrame:
    """(fp, component, component_id) of the distinct fingerprints of ``rows`` (doc_id, fp)."""
    # nodes are fingerprints, so a group of copies is one node; its least id is aggregated
    least = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    found = components(links(least, max_bits), "simhash")
    member = (least.join(found.withColumnRenamed("node", "fp"), "fp", "left")
              .select("fp", "least", F.coalesce("component", "fp").alias("component")))
    lowest = member.groupBy("component").agg(F.min("least").alias("component_id"))
    return stored(member.join(lowest, "component").select("fp", "component", "component_id"), "simhash-components")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row: 16 hexadecimal digits, and the
    smallest doc_id that links lead to."""
    rows = stored(fingerprints(docs, doc_id, text, shingle).drop("key"), "simhash-fingerprints")
    return (rows.join(_component_of_fingerprint(rows, max_bits), "fp", "left")
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
             max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one document of each near-duplicate group: the smallest non-null id,
    among equal ids the smallest text hash, of repeated rows any one.

    A bitmap of fixed size has the keys of all rows that go or are repeated.  Rows it does
    not have stay where they are read; only the others meet the kept keys in a shuffle."""
    rows = stored(fingerprints(docs, doc_id, text, shingle), "simhash-fingerprints")
    best = (rows.join(_component_of_fingerprint(rows, max_bits).select("fp", "component"), "fp")
            .groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")).alias("b")))
    kept = stored(best.select(F.col("b.doc_id").alias("_id1"), F.col("b.key").alias("_key1")), "simhash-kept")
    each = rows.groupBy("doc_id", "key").count()
    lone = each.where("count = 1")
    gone = lone.join(kept, (lone["key"] == kept["_key1"]) & lone["doc_id"].eqNullSafe(kept["_id1"]), "left_anti")
    suspect = gone.select("key").unionByName(each.where("count > 1").select("key"))
    words = docs.sparkSession.sparkContext.broadcast(bitmap(suspect, "key", 27))

    @F.pandas_udf("boolean")
    def suspected(keys: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(keys.to_numpy(np.int64).view(np.uint64), words.value))

    mine = docs.withColumn("_key0", F.xxhash64(F.col(doc_id).cast("long"), F.col(text).cast("binary")))
    mine = mine.withColumn("_maybe0", suspected(F.col("_key0")))
    some = mine.where("_maybe0")
    some = some.join(kept, (some["_key0"] == kept["_key1"]) & some[doc_id].cast("long").eqNullSafe(kept["_id1"]), "left_semi")
    out = mine.where("not _maybe0").unionByName(some.dropDuplicates([doc_id, "_key0"]))
    return out.select(*docs.columns)
