"""Language-model scores: a gated recurrent network with class-factored output softmax.

Tokens are the text's words (A-Z lower-cased, ``[^\\x20\\x09-\\x0D]+``) and one end.  Counts
of all training words are gathered in the cluster.  The most frequent :data:`MODEL` words
are symbols of the network, with ``end`` and ``other``; symbols are sorted by count and
cut into classes of :data:`CLASS`, so a symbol's probability is that of its class times
that within its class.  A word that is no symbol has the probability of ``other`` times
its smoothed share of all such words.  Thus every text has a complete probability.

Training: every training document is cut into consecutive windows of :data:`SPAN` tokens, so
all words are learned from, each in one round.  Each task trains its own copy on its documents by
truncated backpropagation (segments of :data:`SEGMENT` steps, the state carried through the
document), and the copies' mean starts the next round; tasks grow with the tokens.  Scoring carries the state through whole documents.

Scale: words with the largest counts (at most :data:`HEAD`) are broadcast; the rare ones,
which are most different words but few tokens, are joined by shuffle.

Defined cases: a null text is empty and has the end alone; without training rows every
count is 0 and the network is the untrained one; repeated rows are scored alike; ties in
counts go by the word's bytes; extra columns are ignored; an empty table gives no rows; long texts are read whole.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from respan.llm import gru
from respan.llm.util import batched, bound_batches, stored

HEAD, MODEL = 100_000, 1022
CLASS, HIDDEN = 32, 16
SPAN, SEGMENT, LANES, RATE, ROUNDS = 32, 16, 128, 0.01, 2
#: Training windows a task: enough that the longest documents leave few turns with few lanes.
TASK_WINDOWS = 32_000
#: Steps whose outputs are computed at a time, and lanes that run side by side.
STEPS, SCORE_LANES = 32, 512
#: Targets of one class that one product takes, and targets whose outputs are worked on at a time.
BLOCK, OUTPUTS = 32, 2048
END, OTHER = 0, 1
LN10 = float(np.log(10))


# ---------------------------------------------------------------- counts
def word_counts(rows: DataFrame, limit: int = 400_000) -> DataFrame:
    """(word, c) over the texts ``t`` (bytes) of ``rows``; tasks add up before they shuffle."""
    schema = pa.schema([("word", pa.binary()), ("c", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            words = list(counts)
            for i in range(0, len(words), 50_000):
                part = words[i:i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([counts[w] for w in part])],
                                                 schema=schema)
            counts.clear()

        for cols in batched(batches):
            for t in cols["t"]:
                if t:
                    counts.update(t.lower().split())
                if len(counts) > limit:
                    yield from flush()
        yield from flush()

    return rows.select("t").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Vocabulary:
    """Totals of the training tokens, and the head's counts and symbols (bounded)."""

    def __init__(self, counts: DataFrame, n_docs: int, head: int = HEAD, model: int = MODEL):
        level = F.floor(F.log2("c") * 8).cast("int")  # at most 8 * 63 levels
        levels = {r["l"]: (r["n"], r["s"]) for r in counts.groupBy(level.alias("l"))
                  .agg(F.count("*").alias("n"), F.sum("c").alias("s")).collect()}
        size, self.cut = 0, max(levels, default=0) + 1
        for k in sorted(levels, reverse=True):
            if size + levels[k][0] > head:
                break
            size, self.cut = size + levels[k][0], k
        self.level = level
        self.docs = n_docs
        self.tokens = sum(s for _, s in levels.values()) + n_docs
        self.distinct = sum(n for n, _ in levels.values()) + (n_docs > 0)
        words = counts.where(level >= self.cut).collect()
        words = sorted(((-r["c"], bytes(r["word"])) for r in words))
        self.index = {w: i for i, (_, w) in enumerate(words)}
        self.counts = np.array([-c for c, _ in words], np.float64)
        self.symbol = np.full(len(words) + 1, OTHER, np.int32)
        n = min(model, len(words))
        self.symbol[:n] = np.arange(2, n + 2)
        self.symbols = n + 2
        in_model = float(self.counts[:n].sum())
        self.other_tokens = self.tokens - n_docs - in_model
        # log10 of the denominators of all words' and of the other words' smoothed shares
        self.base = float(np.log10(self.tokens + 0.5 * (self.distinct + 1)))
        self.other = float(np.log10(self.other_tokens + 0.5 * (self.distinct - (n_docs > 0) - n + 1)))
        self.symbol_counts = np.concatenate([[n_docs, self.other_tokens], self.counts[:n]])


# ---------------------------------------------------------------- the network
def new_model(symbol_counts: np.ndarray, seed: int = 11) -> dict[str, np.ndarray]:
    """Parameters whose output starts at the symbols' shares."""
    rng = np.random.default_rng(seed)
    n = len(symbol_counts)
    classes = -(-n // CLASS)
    p = gru.init(HIDDEN, n, rng)
    share = np.full(classes * CLASS, 0.0)
    share[:n] = symbol_counts + 0.5
    share = (share / share.sum()).reshape(classes, CLASS)
    per = share.sum(axis=1, keepdims=True)
    p["C"] = rng.normal(0, 0.05, (classes, HIDDEN)).astype(np.float32)
    p["cb"] = np.log(per[:, 0] + 1e-12).astype(np.float32)
    p["D"] = rng.normal(0, 0.05, (classes, CLASS, HIDDEN)).astype(np.float32)
    p["db"] = np.log(share / (per + 1e-12) + 1e-30).astype(np.float32)  # absent symbols stay near zero
    return p


def class_blocks(cls: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions sorted by class in blocks of :data:`BLOCK` of one class each, so that all classes
    are one batched product: the slot of each position, the position in each slot (a free slot
    has position 0) and the number of blocks of each class."""
    order = np.argsort(cls.astype(np.min_scalar_type(classes)), kind="stable")
    n = np.bincount(cls, minlength=classes)
    blocks = -(-n // BLOCK)
    at = np.arange(len(cls)) + np.repeat((np.cumsum(blocks) - blocks) * BLOCK - (np.cumsum(n) - n), n)
    slot = np.empty(len(cls), np.int64)
    slot[order] = at
    source = np.zeros(int(blocks.sum()) * BLOCK, np.int64)
    source[at] = order
    return slot, source, blocks


def _blocked(rows: np.ndarray) -> np.ndarray:
    """(features, slots) as (blocks, features, BLOCK), not copied."""
    return rows.reshape(len(rows), -1, BLOCK).transpose(1, 0, 2)


def _with_ones(h: np.ndarray) -> np.ndarray:
    out = np.ones((len(h) + 1, h.shape[1]), np.float32)
    out[:-1] = h
    return out


def _outputs(p: dict) -> tuple[np.ndarray, np.ndarray]:
    """Weights of classes and of symbols in their classes, the bias in the last column."""
    return np.c_[p["C"], p["cb"]], np.concatenate([p["D"], p["db"][:, :, None]], axis=2)


def _exponentials(logits: np.ndarray) -> np.ndarray:
    """Exponentials in place, the largest of a column 1; returns the columns' sums."""
    logits -= logits.max(axis=0)
    np.exp(logits, out=logits)
    return logits.sum(axis=0)


def log_probabilities(p: dict, h: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Natural log of the probability of symbols ``y`` after states ``h`` (n, H)."""
    out = np.empty(len(y))
    c, d = _outputs(p)
    for s in range(0, len(y), OUTPUTS):  # what is worked on stays in the processor's cache
        h1, part = _with_ones(h[s:s + OUTPUTS].T), y[s:s + OUTPUTS]
        cls, at = part // CLASS, np.arange(len(part))
        logits = c @ h1
        logits -= logits.max(axis=0)
        picked = logits[cls, at]
        got = picked - np.log(np.exp(logits, out=logits).sum(axis=0))
        slot, source, blocks = class_blocks(cls, len(c))
        inside = np.empty((CLASS, len(source)), np.float32)
        np.matmul(np.repeat(d, blocks, axis=0), _blocked(np.take(h1, source, axis=1, mode="clip")), out=_blocked(inside))
        inside -= inside.max(axis=0)
        picked = inside[part % CLASS, slot]
        out[s:s + OUTPUTS] = got + (picked - np.log(np.exp(inside, out=inside).sum(axis=0))[slot])
    return out


def output_gradients(p: dict, h: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Gradients of the mean loss of symbols ``y`` (n; -1: no target) after states ``h`` (H, n):
    of the output's parameters and of the states."""
    c, d = _outputs(p)
    h1 = _with_ones(h)
    weight = (y >= 0) / np.float32(max(1, np.count_nonzero(y >= 0)))
    y = np.maximum(y, 0)
    cls = y // CLASS
    e = c @ h1
    sums = _exponentials(e)
    e *= weight / sums
    e[cls, np.arange(len(y))] -= weight
    dc, dh = e @ h1.T, p["C"].T @ e
    slot, source, blocks = class_blocks(cls, len(c))
    weights, hb = np.repeat(d, blocks, axis=0), np.take(h1, source, axis=1, mode="clip")
    e = np.empty((CLASS, len(source)), np.float32)
    np.matmul(weights, _blocked(hb), out=_blocked(e))
    share = np.zeros(len(source), np.float32)  # free slots have none
    share[slot] = weight
    sums = _exponentials(e)
    e *= share / sums
    e[y % CLASS, slot] -= weight
    some = np.flatnonzero(blocks)
    dd = np.zeros_like(d)
    dd[some] = np.add.reduceat(np.matmul(_blocked(e), _blocked(hb).transpose(0, 2, 1)), (np.cumsum(blocks) - blocks)[some])
    back = np.empty((len(h), len(source)), np.float32)
    np.matmul(weights[:, :, :-1].transpose(0, 2, 1), _blocked(e), out=_blocked(back))
    dh += np.take(back, slot, axis=1, mode="clip")
    return {"C": dc[:, :-1], "cb": dc[:, -1], "D": dd[:, :, :-1], "db": dd[:, :, -1]}, dh


def dealt(sizes: np.ndarray, lanes: int) -> list[list[int]]:
    """Documents of each lane, of about equal length together, the longest lane first."""
    heap, owner = [(0, k) for k in range(lanes)], [[] for _ in range(lanes)]
    for i in np.argsort(-sizes, kind="stable").tolist():
        load, k = heapq.heappop(heap)
        owner[k].append(i)
        heapq.heappush(heap, (load + int(sizes[i]), k))
    return [owner[k] for _, k in sorted(heap, reverse=True)]


def train_windows(p: dict[str, np.ndarray], windows: np.ndarray, sizes: np.ndarray | None = None,
                  lanes: int = LANES) -> dict[str, np.ndarray]:
    """A copy of ``p`` after one pass over windows (n, SPAN + 1) of symbols, padded with -1.

    ``sizes`` has the windows of each document, one after another (none: one each); the state
    is carried from window to window of a document."""
    p = {k: v.copy() for k, v in p.items()}
    opt = gru.Adam(p, RATE)
    sizes = np.ones(len(windows), np.int64) if sizes is None else sizes
    begin = np.cumsum(sizes) - sizes
    lanes = min(lanes, len(sizes))
    rng = np.random.default_rng(13)
    order = [np.concatenate([np.arange(begin[i], begin[i] + sizes[i]) for i in rng.permutation(mine)])
             for mine in dealt(sizes, lanes) if mine]
    begins = np.zeros(len(windows), bool)
    begins[begin] = True
    long = np.array([len(o) for o in order])
    h = np.zeros((HIDDEN, len(order)), np.float32)
    for turn in range(int(long[0]) if len(long) else 0):
        active = int((long > turn).sum())  # lanes are sorted by length
        at = np.array([o[turn] for o in order[:active]])
        w = windows[at]
        h = np.where(begins[at], np.float32(0), h[:, :active])
        for s in range(0, SPAN, SEGMENT):
            x, y = np.maximum(w[:, s:s + SEGMENT].T, 0, order="C"), w[:, s + 1:s + SEGMENT + 1].T
            used = np.count_nonzero(y >= 0)
            if not used:
                break
            states, tape = gru.forward(p, x, h)
            flat = states.transpose(1, 0, 2).reshape(HIDDEN, -1)
            grads, dh = output_gradients(p, flat, y.ravel())
            grads |= gru.backward(p, x, tape, dh.reshape(HIDDEN, len(x), len(w)).transpose(1, 0, 2))
            opt.update(grads, used / (lanes * SEGMENT))  # few tokens, such as a long text's end, move it less
            h = states[-1]  # the state goes on, the gradient does not
    return p


def document_log_probabilities(p: dict, docs: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each symbol sequence (ends included), states carried throughout.

    Documents are dealt to lanes of about equal length; a lane runs its documents one
    after another and starts each with a zero state."""
    out = np.zeros(len(docs))
    if not docs:
        return out
    size = np.array([len(d) for d in docs])
    lanes = int(np.clip(size.sum() // max(size.max(), 1), 1, SCORE_LANES))
    heap, owner = [(0, k) for k in range(lanes)], [[] for _ in range(lanes)]
    for i in np.argsort(-size, kind="stable").tolist():
        load, k = heapq.heappop(heap)
        owner[k].append(i)
        heapq.heappush(heap, (load + int(size[i]), k))
    steps = max(load for load, _ in heap)
    y = np.full((lanes, steps), -1, np.int32)
    x = np.zeros((lanes, steps), np.int32)
    of = np.zeros((lanes, steps), np.int32)
    begins = np.zeros((lanes, steps), bool)
    for k, mine in enumerate(owner):
        at = 0
        for i in mine:
            n = size[i]
            y[k, at:at + n] = docs[i]
            x[k, at + 1:at + n] = docs[i][:-1]
            x[k, at], begins[k, at], of[k, at:at + n] = END, True, i
            at += n
    x, y, of, begins = (np.ascontiguousarray(a.T) for a in (x, y, of, begins))
    starts = begins.any(axis=1)
    h = np.zeros((HIDDEN, lanes), np.float32)
    cols = np.empty((3 * HIDDEN, lanes), np.float32)
    for s in range(0, steps, STEPS):
        part = slice(s, min(s + STEPS, steps))
        states = np.empty((HIDDEN, part.stop - s, lanes), np.float32)
        for t in range(s, part.stop):
            if starts[t]:
                h = np.where(begins[t], np.float32(0), h)
            np.take(p["U"], x[t], axis=1, out=cols, mode="clip")
            h = gru.step(cols, p["W"], h)
            states[:, t - s] = h
        use = np.flatnonzero(y[part].ravel() >= 0)
        lp = log_probabilities(p, np.take(states.reshape(HIDDEN, -1), use, axis=1).T, y[part].ravel()[use])
        out += np.bincount(of[part].ravel()[use], weights=lp, minlength=len(docs))
    return out / LN10


# ---------------------------------------------------------------- training in the cluster
def text_windows(symbols: np.ndarray) -> np.ndarray:
    """All windows of a text's symbols, one after another: the symbol before each and SPAN
    targets, the last of all END; padded with -1."""
    n = -(-(len(symbols) + 1) // SPAN)
    s = np.full(n * SPAN + 1, -1, np.int32)
    s[0], s[1:len(symbols) + 1], s[len(symbols) + 1] = END, symbols, END
    return np.lib.stride_tricks.sliding_window_view(s, SPAN + 1)[::SPAN]


def _windows(rows: DataFrame, vocab) -> DataFrame:
    """All windows of each row (key, t), flat."""
    schema = pa.schema([("key", pa.int64()), ("w", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, symbol = vocab.value.index.get, vocab.value.symbol
        for cols in batched(batches):
            out = []
            for t in cols["t"]:
                words = (t or b"").lower().split()
                at = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
                out.append(text_windows(symbol[at]).ravel())
            offsets = np.concatenate([[0], np.cumsum([len(w) for w in out])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols["key"], pa.int64()), pa.ListArray.from_arrays(offsets, np.concatenate(out))], schema=schema)

    return rows.select("key", "t").mapInArrow(run, "key long, w array<int>")


def train(rows: DataFrame, vocab: Vocabulary, shared) -> dict[str, np.ndarray]:
    """Rounds of local training in tasks and averaging in the cluster."""
    spark = rows.sparkSession
    p = new_model(vocab.symbol_counts)
    if not vocab.docs:
        return p
    windows = stored(_windows(rows, shared), "lm-windows")
    names = sorted(p)
    shapes = {k: p[k].shape for k in names}
    tasks = max(1, int(vocab.tokens) // (ROUNDS * TASK_WINDOWS * SPAN))
    schema = pa.schema([("n", pa.int64()), ("v", pa.list_(pa.float32()))])
    for turn in range(ROUNDS):
        start = spark.sparkContext.broadcast(p)

        def run(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            got = [(np.array(b.column(0).flatten()), np.array(b.column(0).value_lengths())) for b in batches if b.num_rows]
            if got:
                w = np.concatenate([a for a, _ in got]).reshape(-1, SPAN + 1)
                q = train_windows(start.value, w, np.concatenate([n for _, n in got]) // (SPAN + 1))
                flat = np.concatenate([q[k].ravel() for k in names]).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([len(w)], pa.int64()),
                                                  pa.array([flat], pa.list_(pa.float32()))], schema=schema)

        mine = windows.where(F.pmod("key", F.lit(ROUNDS)) == turn).repartition(tasks, "key").sortWithinPartitions("key")
        sums = (mine.select("w").mapInArrow(run, "n long, v array<float>")
                .select("n", F.posexplode("v").alias("i", "v"))
                .groupBy("i").agg((F.sum(F.col("v").cast("double") * F.col("n")) / F.sum("n")).alias("v")))
        mean = sums.toArrow()  # as many rows as the network has parameters
        if not mean.num_rows:
            continue
        flat = np.empty(mean.num_rows, np.float64)
        flat[mean.column("i").to_numpy()] = mean.column("v").to_numpy()
        at = 0
        p = {}
        for k in names:
            n = int(np.prod(shapes[k]))
            p[k] = flat[at:at + n].reshape(shapes[k]).astype(np.float32)
            at += n
    return p


# ---------------------------------------------------------------- scores
def _scored(rows: DataFrame, model, vocab) -> DataFrame:
    """A row each with what head words and the network give, and its rare words' counts."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n_tokens", pa.int64()), ("known", pa.int64()),
                        ("base", pa.float64()), ("net", pa.float64()), ("others", pa.int64()),
                        ("words", pa.list_(pa.binary())), ("ns", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, p = vocab.value, model.value
        get = v.index.get
        logs = np.log10(np.append(v.counts, 0) + 0.5)
        logs[-1] = 0.0  # rare words come by the join
        end = float(np.log10(v.docs + 0.5))
        for cols in batched(batches):
            n, known, base, others, words, ns, symbols = [], [], [], [], [], [], []
            for t in cols["t"]:
                ws = (t or b"").lower().split()
                at = np.fromiter(map(get, ws, repeat(-1)), np.int64, len(ws))
                sym = v.symbol[at]
                rare = Counter([ws[i] for i in np.flatnonzero(at < 0).tolist()])
                other = sym == OTHER
                n.append(len(ws) + 1)
                known.append(int((at >= 0).sum()) + (v.docs > 0))
                base.append((float(logs[at].sum()) + end, float(logs[at[other]].sum())))
                others.append(int(other.sum()))
                words.append(list(rare.keys()))
                ns.append(list(rare.values()))
                symbols.append(np.append(sym, END).astype(np.int32))
            net = document_log_probabilities(p, symbols) + np.array([b for _, b in base])
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols["d"], pa.int64()), pa.array(cols["key"], pa.int64()), pa.array(n, pa.int64()),
                 pa.array(known, pa.int64()), pa.array([a for a, _ in base]), pa.array(net), pa.array(others, pa.int64()),
                 pa.array(words, pa.list_(pa.binary())), pa.array(ns, pa.list_(pa.int64()))], schema=schema)

    return rows.mapInArrow(run, "doc_id long, key long, n_tokens long, known long, base double, net double, others long, "
                                "words array<binary>, ns array<bigint>")


def score(docs: DataFrame, trains: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    spark = docs.sparkSession
    bound_batches(spark)
    d, raw = F.col(doc_id).cast("long"), F.col(text).cast("binary")
    rows = docs.select(d.alias("d"), F.xxhash64(d, raw).alias("key"), raw.alias("t"))
    training = docs.where(trains).select(F.xxhash64(d, raw).alias("key"), raw.alias("t"))
    counts = stored(word_counts(training), "lm-counts")
    vocab = Vocabulary(counts, training.count())
    level, vocab.level = vocab.level, None  # plain data for the tasks
    shared = spark.sparkContext.broadcast(vocab)
    model = spark.sparkContext.broadcast(train(training, vocab, shared))
    scored = stored(_scored(rows, model, shared), "lm-scored")
    rare = (scored.select("doc_id", "key", F.explode(F.arrays_zip("words", "ns")).alias("z"))
            .select("doc_id", "key", F.col("z.words").alias("word"), F.col("z.ns").alias("n"))
            .join(counts.where(level < vocab.cut), "word", "left")
            .select("doc_id", "key", F.lit(0).alias("m"), F.lit(0).alias("n_tokens"),
                    F.when(F.col("c") > 0, F.col("n")).otherwise(F.lit(0)).alias("known"),
                    (F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.5))).alias("base"),
                    (F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.5))).alias("net"), F.lit(0).alias("others")))
    own = scored.select("doc_id", "key", F.lit(1).alias("m"), "n_tokens", "known", "base", "net", "others")
    total = own.unionByName(rare).groupBy("doc_id", "key").agg(
        *[F.sum(c).alias(c) for c in ("m", "n_tokens", "known", "base", "net", "others")])
    # equal rows were added up: each is the mean, once for every row
    each = total.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))))
    return each.select(
        "doc_id", (F.col("n_tokens") / F.col("m")).cast("long").alias("n_tokens"),
        (F.col("known") / F.col("m")).cast("long").alias("n_known"), F.lit(int(vocab.tokens)).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("m") - F.col("n_tokens") / F.col("m") * F.lit(vocab.base)).alias("base_score"),
        (F.col("net") / F.col("m") - F.col("others") / F.col("m") * F.lit(vocab.other)).alias("score"))
