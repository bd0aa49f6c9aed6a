"""Periodic runs of words by the branching-tandem test on an enhanced suffix array.

A run is a stretch of words with smallest period q that no neighbouring word extends, at least
``max(6, 4 * q)`` words long.  For the texts of a batch, told apart by document in the first rank:

* the suffix array comes from prefix doubling; the ranks of every doubling are kept, so the
  common length of two suffixes, and of two prefixes, is found by descending over them;
* each LCP interval is the range between the next smaller values on both sides of a boundary
  (descents over range minima); its children lie between its boundaries;
* the suffixes of all children but the largest are tested: if ISA[i + depth] (or ISA[i - depth])
  lies in the interval, outside the child, a square of period ``depth`` starts at i (or i - depth)
  that the next word does not continue;
* every run ends with exactly one such square of its period.  The square is rotated to the left
  as far as the words agree, which gives the run; multiples of a period give the same stretch
  and are merged into the smallest.

A run of at least four periods has four suffixes in its interval, so smaller intervals are
passed over.  No tree node is built; every step is an array operation.  n words take O(n log n).

Defined cases: a null or empty text has no word and no run, its collapsed text is empty; words are
separated by the six ASCII blanks; overlapping runs each count, a word goes if any run
holds it beyond its first period; equal rows give equal rows; an empty table gives no rows; extra
columns are ignored; a text is taken whole, with arrays of about 200 bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from respan.llm.util import batched, bound_batches, split_words

#: Words of texts that are handled together (a longer text stands alone).
WORDS = 1 << 18
#: A run has at least LEAST words and TIMES periods.
LEAST, TIMES = 6, 4


class SuffixArray:
    """Suffixes of several sequences of codes; suffixes of different sequences share nothing."""

    def __init__(self, codes: np.ndarray, doc: np.ndarray):
        n = len(codes)
        self.n = n
        key = doc.astype(np.int64) * (int(codes.max()) + 1) + codes
        self.sa = np.argsort(key, kind="stable")
        new = np.empty(n, bool)
        new[0] = True
        new[1:] = key[self.sa[1:]] != key[self.sa[:-1]]
        #: doubling after which an entry differs from the one before (-1: in its first word)
        self.apart = np.where(new, -1, 0).astype(np.int8)
        begin = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank = np.empty(n, np.int32)
        rank[self.sa] = begin
        self.ranks = [rank]
        last = np.empty(n + 1, np.int64)  # end of the sequence of each word
        ends = np.flatnonzero(np.append(doc[1:] != doc[:-1], True)) + 1
        last[:n] = np.repeat(ends, np.diff(np.concatenate([[0], ends])))
        first = np.concatenate([[0], ends[:-1]])
        self.first = np.repeat(first, ends - first)
        self.last = last[:n]
        self._double(new)
        self.isa = np.empty(n, np.int64)
        self.isa[self.sa] = np.arange(n)
        self.lcp = self._lcp()

    def _double(self, new: np.ndarray) -> None:
        """Sort groups of equal ranks by the ranks that follow, as long as there are any."""
        single = new & np.append(new[1:], True)
        active = np.flatnonzero(~single)  # places in the array
        level = 0
        while len(active):
            rank, h = self.ranks[level], 1 << level
            at = self.sa[active]
            ahead = at + h
            inside = ahead < self.last[at]
            follow = np.zeros(len(at), np.int64)
            follow[inside] = rank[ahead[inside]] + 1
            key = rank[at].astype(np.int64) * (self.n + 1) + follow
            order = np.argsort(key, kind="stable")
            at, key = at[order], key[order]
            self.sa[active] = at
            group = key // (self.n + 1)
            differs = np.append(True, key[1:] != key[:-1])
            split = differs & np.append(False, group[1:] == group[:-1])
            self.apart[active[split]] = level
            begin = np.maximum.accumulate(np.where(differs, active, 0))
            nxt = rank.copy()
            nxt[at] = begin
            self.ranks.append(nxt)
            level += 1
            alone = differs & np.append(differs[1:], True)
            # entries with equal ranks so far stay active
            self.apart[active[~differs]] = level
            active = active[~alone]

    def _lcp(self) -> np.ndarray:
        """Common length of each suffix with the one before it in the array."""
        lcp = np.zeros(self.n, np.int64)
        at = np.flatnonzero(self.apart >= 0)
        level = self.apart[at].astype(np.int64)
        lcp[at] = np.int64(1) << level
        a, b = self.sa[at - 1], self.sa[at]
        for k in range(int(level.max(initial=0)) - 1, -1, -1):
            mine = np.flatnonzero(level > k)
            x, y = a[mine] + lcp[at[mine]], b[mine] + lcp[at[mine]]
            inside = (x < self.last[a[mine]]) & (y < self.last[b[mine]])
            mine, x, y = mine[inside], x[inside], y[inside]
            lcp[at[mine[self.ranks[k][x] == self.ranks[k][y]]]] += 1 << k
        return lcp

    def common_before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words before ``a`` equal those before ``b`` (a < b, one sequence)."""
        out = np.zeros(len(a), np.int64)
        low = self.first[a]
        for k in range(len(self.ranks) - 1, -1, -1):
            h = 1 << k
            mine = np.flatnonzero(a - out - h >= low)
            x = a[mine] - out[mine] - h
            y = b[mine] - out[mine] - h
            out[mine[self.ranks[k][x] == self.ranks[k][y]]] += h
        return out


def _nearest_smaller(lcp: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For boundaries ``at``: the last place before with a smaller value, the first place after
    with a smaller one, and the first after with a smaller or equal one."""
    n = len(lcp)
    table = [lcp]  # minima of 2 ** k values from each place on
    zero = np.flatnonzero(lcp == 0)
    widest = int(np.diff(np.append(zero, n)).max())
    while 1 << len(table) <= widest:
        h = 1 << (len(table) - 1)
        prev = table[-1]
        nxt = prev.copy()
        nxt[:n - h] = np.minimum(prev[:n - h], prev[h:])
        nxt[n - h:] = 0
        table.append(nxt)
    value = lcp[at]

    def after(keeps) -> np.ndarray:
        place = at + 1
        for k in range(len(table) - 1, -1, -1):
            h = 1 << k
            ok = (place + h <= n) & keeps(table[k][np.minimum(place, n - 1)], value)
            place = np.where(ok, place + h, place)
        return place

    before = at
    for k in range(len(table) - 1, -1, -1):
        h = 1 << k
        ok = (before >= h) & (table[k][np.maximum(before - h, 0)] >= value)
        before = np.where(ok, before - h, before)
    return before - 1, after(np.greater_equal), after(np.greater)


def _ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges ``first`` to ``last`` (exclusive), and the range of each."""
    size = last - first
    owner = np.repeat(np.arange(len(first)), size)
    return np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + first[owner], owner


def branching_squares(sfx: SuffixArray, least: int = TIMES) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of the squares that the next word does not continue, from LCP intervals
    of at least ``least`` suffixes (a square may come twice)."""
    at = np.flatnonzero(sfx.lcp > 0)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    left, right, nxt = _nearest_smaller(sfx.lcp, at)  # interval: left .. right - 1
    keep = right - left >= least
    at, left, right, nxt = at[keep], left[keep], right[keep], nxt[keep]
    depth = sfx.lcp[at]
    # children: from each boundary to the next one, and before the first boundary of an interval
    _, head, interval = np.unique(left * (sfx.n + 1) + depth, return_index=True, return_inverse=True)
    child_from = np.concatenate([at, left[head]])
    child_to = np.concatenate([nxt, at[head]])
    owner = np.concatenate([interval, np.arange(len(head))])
    size = child_to - child_from
    order = np.lexsort((size, owner))
    largest = order[np.append(owner[order][1:] != owner[order][:-1], True)] if len(order) else order
    small = np.ones(len(size), bool)
    small[largest] = False
    child_from, child_to, owner = child_from[small], child_to[small], owner[small]
    place, child = _ranges(child_from, child_to)
    i, mine = sfx.sa[place], owner[child]
    d, lo, hi = depth[head][mine], left[head][mine], right[head][mine]
    out = []
    for j, inside in ((i + d, i + d < sfx.last[i]), (i - d, i - d >= sfx.first[i])):
        isa = sfx.isa[np.clip(j, 0, sfx.n - 1)]
        found = inside & (isa >= lo) & (isa < hi) & ((isa < child_from[child]) | (isa >= child_to[child]))
        out.append((np.minimum(i, j)[found], d[found]))
    return np.concatenate([s for s, _ in out]), np.concatenate([d for _, d in out])


def periodic_runs(codes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of every run, by start and period; ``doc`` numbers the
    sequences (ascending), starts are places in ``codes``."""
    if not len(codes):
        return (np.zeros(0, np.int64),) * 3
    sfx = SuffixArray(codes, doc)
    start, period = branching_squares(sfx)
    back = sfx.common_before(start, start + period)
    length = back + 2 * period
    start = start - back
    keep = length >= np.maximum(LEAST, TIMES * period)
    start, length, period = start[keep], length[keep], period[keep]
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    smallest = np.append(True, (start[1:] != start[:-1]) | (length[1:] != length[:-1])) if len(start) else np.zeros(0, bool)
    start, length, period = start[smallest], length[smallest], period[smallest]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def dropped(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which of ``n`` words some run holds beyond its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    return np.cumsum(change[:n]) > 0


def _greatest(start: np.ndarray, length: np.ndarray, period: np.ndarray) -> int:
    """Number of the run with the greatest exact length / period (then start, then period)."""
    best = 0
    rows = list(zip(start.tolist(), length.tolist(), period.tolist(), strict=True))
    for k in range(1, len(rows)):
        if rows[k][1] * rows[best][2] > rows[best][1] * rows[k][2]:
            best = k
    return best


def text_runs(texts: list[bytes]) -> Iterator[tuple[list[bytes], list[tuple[int, int, int]], int | None, bytes]]:
    """(words, runs, greatest run's number, collapsed text) of each UTF-8 text."""
    ids: dict[bytes, int] = {}
    words = [split_words(t) for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    codes = np.fromiter((ids.setdefault(w, len(ids)) for line in words for w in line), np.int64, int(sizes.sum()))
    start, length, period = periodic_runs(codes, np.repeat(np.arange(len(texts)), sizes))
    edge = np.concatenate([[0], np.cumsum(sizes)])
    cut = np.searchsorted(start, edge)
    for k, line in enumerate(words):
        mine = slice(cut[k], cut[k + 1])
        s, n, p = start[mine] - edge[k], length[mine], period[mine]
        if not len(s):
            yield line, [], None, b" ".join(line)
            continue
        gone = dropped(len(line), s, n, p).tolist()
        kept = b" ".join([w for w, g in zip(line, gone, strict=True) if not g])
        yield line, list(zip(s.tolist(), n.tolist(), p.tolist(), strict=True)), _greatest(s, n, p), kept


RUN = "struct<start: bigint, length: bigint, period: bigint>"


def find_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, greatest, collapsed) of every document: all runs by start and
    period, the one with most periods (null without runs), and the text with each run cut to its first period."""
    bound_batches(docs.sparkSession, 8 << 20)
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(run_type)), ("greatest", run_type),
                        ("collapsed", pa.binary())])

    def row(r: tuple[int, int, int]) -> dict:
        return {"start": r[0], "length": r[1], "period": r[2]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in batched(batches):
            texts, a = [t or b"" for t in cols["t"]], 0
            while a < len(texts):
                b, room = a, WORDS
                while b < len(texts) and (b == a or len(texts[b]) < 6 * room):
                    room -= len(texts[b]) // 6
                    b += 1
                out: list[list] = [[] for _ in schema]
                for d, (line, runs, best, kept) in zip(cols["d"][a:b], text_runs(texts[a:b]), strict=True):
                    greatest = None if best is None else row(runs[best])
                    for col, v in zip(out, (d, len(line), [row(r) for r in runs], greatest, kept), strict=True):
                        col.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)
                a = b

    rows = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).cast("binary").alias("t"))
    out = rows.mapInArrow(run, f"doc_id long, n_words long, runs array<{RUN}>, greatest {RUN}, collapsed binary")
    return out.withColumn("collapsed", F.col("collapsed").cast("string"))
