"""Fill-in-middle transformation with Fenwick trees over fixed text blocks.

Units are ``[A-Za-z]+|[^A-Za-z]``, matched left to right.  A text is cut into blocks of
:data:`BLOCK` UTF-8 bytes; one Fenwick tree holds the number of units that start in each block,
another the number of code points.  A cut after k units is found by a binary-lifting descent
to the block in which unit k starts, then inside that block alone; its code points are a prefix
sum of the second tree and a count inside the block.

Two hashed cuts part the text into prefix, middle and suffix, written as

    psm:  <P>prefix<S>suffix<M>middle        spm:  <S>suffix<P>prefix<M>middle

or left plain.  All choices are functions of the document id, so lost tasks give the same rows again.

Defined cases: a null text is empty; an empty text, one that holds a sentinel, and the hashed
share stay plain (``prefix_chars`` and ``middle_chars`` are null); a null id counts as the empty
string in the hash; repeated rows give equal rows; an empty table gives no rows; extra columns
are ignored; a text of any length takes a few arrays of its own size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from respan.llm.util import batched, bound_batches

BLOCK = 1024
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of documents that are transformed, and percent of those in suffix-first form.
RATE, SPM = 90, 20


class Fenwick:
    """Binary indexed tree of counts."""

    def __init__(self, counts: np.ndarray):
        total = np.concatenate([[0], np.cumsum(counts)])
        i = np.arange(len(total))
        self.tree = total - total[i & (i - 1)]  # node i covers its lowest set bit's worth of items
        self.tree[0] = 0

    def prefix(self, n: int) -> int:
        """Sum of the first ``n`` counts."""
        out = 0
        while n:
            out += int(self.tree[n])
            n &= n - 1
        return out

    def descend(self, k: int) -> tuple[int, int]:
        """(items, rest): the most leading items whose sum is at most ``k``, and what is left of it."""
        at, step = 0, 1 << (len(self.tree) - 1).bit_length()
        while step:
            if at + step < len(self.tree) and self.tree[at + step] <= k:
                at += step
                k -= int(self.tree[at])
            step >>= 1
        return at, k


class Blocks:
    """Unit and code-point counts of a UTF-8 text by blocks."""

    def __init__(self, text: bytes, block: int = BLOCK):
        raw = np.frombuffer(text, np.uint8)
        letter = ((raw | np.uint8(32)) - np.uint8(97)) < 26
        self.size, self.block = len(raw), block
        self.point = (raw & np.uint8(0xC0)) != 0x80
        self.unit = self.point.copy()
        self.unit[1:] &= ~(letter[1:] & letter[:-1])
        edges = np.arange(0, len(raw), block)
        self.units = Fenwick(np.add.reduceat(self.unit, edges, dtype=np.int64) if len(raw) else edges)
        self.points = Fenwick(np.add.reduceat(self.point, edges, dtype=np.int64) if len(raw) else edges)
        self.n = self.units.prefix(len(edges))

    def cut(self, k: int) -> tuple[int, int]:
        """(bytes, code points) before unit ``k``; all of them for the number of units."""
        b, rest = self.units.descend(k)
        first = b * self.block
        if first >= self.size:
            return self.size, self.points.prefix(b)
        local = int(np.flatnonzero(self.unit[first:first + self.block])[rest])
        return first + local, self.points.prefix(b) + int(self.point[first:first + local].sum())


def hashes(doc_id) -> list[int]:
    """Four unsigned 32-bit numbers of a document id."""
    d = hashlib.sha256(b"1:" + (b"" if doc_id is None else str(doc_id).encode())).digest()
    return [int.from_bytes(d[i:i + 4], "big") for i in (0, 4, 8, 12)]


def transform_text(doc_id, text: bytes, rate: int = RATE, spm: int = SPM, block: int = BLOCK) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one UTF-8 text."""
    blocks = Blocks(text, block)
    h1, h2, h3, h4 = hashes(doc_id)
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    if not text or h3 % 100 >= rate or p in text or s in text or m in text:
        return blocks.n, "plain", None, None, text
    low, high = sorted((h1 % (blocks.n + 1), h2 % (blocks.n + 1)))
    (a, chars), (b, more) = blocks.cut(low), blocks.cut(high)
    head, body, tail = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        return blocks.n, "spm", chars, more - chars, b"".join([s, tail, p, head, m, body])
    return blocks.n, "psm", chars, more - chars, b"".join([p, head, s, tail, m, body])


def transform(docs: DataFrame, rate: int = RATE, spm: int = SPM, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every document."""
    bound_batches(docs.sparkSession, 8 << 20)
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
                        ("middle_chars", pa.int64()), ("output", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in batched(batches):
            rows = [(d, *transform_text(d, t or b"", rate, spm)) for d, t in zip(cols["d"], cols["t"], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)],
                                             schema=schema)

    rows = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).cast("binary").alias("t"))
    out = rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary")
    return out.withColumn("output", F.col("output").cast("string"))


def restored(form, output):
    """Column expression: the text before :func:`transform`, from its form and output alone.

    No part holds a sentinel and none arises where parts meet one, so the first match is the cut."""
    def parts(first: str, second: str):
        rest = F.substring(output, 4, 2**31 - 1)
        a = F.substring_index(rest, second, 1)
        tail = F.substr(rest, F.char_length(a) + F.lit(4))
        b = F.substring_index(tail, MIDDLE, 1)
        return a, b, F.substr(tail, F.char_length(b) + F.lit(4))

    prefix, suffix, middle = parts(PREFIX, SUFFIX)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(SUFFIX, PREFIX)
    spm = F.concat(prefix, middle, suffix)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
