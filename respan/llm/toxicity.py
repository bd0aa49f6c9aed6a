"""Toxicity by weak supervision.

Many weak voters look at a text: lexicon voters (a word occurs), stem voters (a word
starts with given letters) and pattern voters (shouting, exclamation, address).  Lexicon
and stems are found by their association with the label in a bounded sample of labelled
training texts (:data:`PER_CLASS`), in which copies of a text are one text and every
feature that passes is a voter.  A generative label model with the label as hidden
class estimates by expectation maximisation how often each voter fires in each class
(the annotator is one more voter, whose accuracy is estimated too), and from the
votes' correlations within the classes how much of each vote is news: correlated voters
share their weight.  Its posterior labels train a logistic classifier on hit counts,
densities and patterns, which scores every whole text.

Defined cases: null and empty texts have no hits and get the classifier's score for that;
without a training label of each class every score is 0; a document with several labels
counts as toxic if one says so, a text with several documents if half of them do; null
labels are ignored; repeated rows are scored alike;
extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from respan.llm.util import batched, bound_batches, stored

#: Bound of the training sample: distinct labelled texts of each class.
PER_CLASS = 6000
#: Voters taken from the association test: least toxic texts, z value and precision.
LEAST_DOCUMENTS, LEAST_Z, LEAST_PRECISION = 4, 6.0, 0.9
STEMS = (4, 5, 6)
#: Votes that correlate more than this within the classes share their weight.
CORRELATED = 0.5
EDGE = " \t\r\n.,;:!?\"'()[]{}<>«»„“”‘’…*_-"
_SHOUT = re.compile(r"\b[A-Z]{4,}\b")
PATTERNS = ("shouting", "exclaims", "addresses", "long", "quiet")


def features(word: str) -> tuple[str, ...]:
    """Lexicon and stem features of a lower-cased word."""
    w = word.strip(EDGE)
    if not w:
        return ()
    return ("=" + w, *("^" + w[:k] for k in STEMS if len(w) > k))


def sample(docs: DataFrame, labels: DataFrame, trains: Column, doc_id: str, text: str, label: str) -> DataFrame:
    """(text, y, rate) of at most about ``PER_CLASS`` distinct labelled texts a class, by
    hash of the text; ``rate`` is the sampled share of the class.  Written once."""
    known = (labels.where(trains & F.col(label).isNotNull() & F.col(doc_id).isNotNull())
             .groupBy(F.col(doc_id).cast("long").alias("_id")).agg(F.max(F.col(label)).cast("int").alias("y")))
    t = F.coalesce(F.col(text), F.lit(""))
    hashed = docs.select(F.col(doc_id).cast("long").alias("_id"), F.xxhash64(t).alias("_text"))
    # copies of a text are one piece of evidence; the smallest id stands for them
    distinct = stored(hashed.join(known, "_id").groupBy("_text")
                      .agg((F.avg("y") >= 0.5).cast("int").alias("y"), F.min("_id").alias("_id")), "toxicity-texts")
    counts = {r["y"]: r["count"] for r in distinct.groupBy("y").count().collect()}
    rate = F.lit(0.0)
    for y, n in counts.items():
        rate = F.when(F.col("y") == y, F.lit(min(1.0, PER_CLASS / n))).otherwise(rate)
    u = F.pmod(F.xxhash64("_text", F.lit("toxicity sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # the expected number of rows is bounded by the classes times PER_CLASS
    picked = distinct.withColumn("rate", rate).where(u < F.col("rate"))
    texts = docs.select(F.col(doc_id).cast("long").alias("_id"), F.xxhash64(t).alias("_text"), t.alias("t"))
    return stored(texts.join(F.broadcast(picked), ["_id", "_text"]).dropDuplicates(["_text"]).select("t", "y", "rate"),
                  "toxicity-sample")


def associated(rows: DataFrame, n1: int, n0: int, odds: float) -> list[str]:
    """All features that fire in toxic texts more than chance explains, strongest first;
    the sample bounds their number.

    ``odds`` is the sampling rate of toxic rows over that of the others; the precision is
    that among all labelled rows."""
    schema = pa.schema([("f", pa.string()), ("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, tuple] = {}
        for cols in batched(batches):
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            for t, y in zip(cols["t"], cols["y"], strict=True):
                seen: set[str] = set()
                for w in set((t or "").lower().split()):
                    if w not in memo:
                        memo[w] = features(w)
                    seen.update(memo[w])
                counts[y].update(seen)
            if len(memo) > 500_000:
                memo.clear()
            keys = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([counts[1][k] for k in keys]),
                                              pa.array([counts[0][k] for k in keys])], schema=schema)

    total = (rows.select("t", "y").mapInArrow(run, "f string, a long, b long").groupBy("f")
             .agg(F.sum("a").alias("a"), F.sum("b").alias("b")))
    p = (F.col("a") + F.col("b")) / F.lit(float(n1 + n0))
    gap = F.col("a") / F.lit(float(n1)) - F.col("b") / F.lit(float(n0))
    z = gap / F.sqrt(p * (1 - p) * F.lit(1 / n1 + 1 / n0) + F.lit(1e-12))
    strong = (total.withColumn("z", z).where(f"a >= {LEAST_DOCUMENTS} and z > {LEAST_Z}")
              .where(F.col("a") / (F.col("a") + F.lit(odds) * F.col("b")) >= LEAST_PRECISION)
              .orderBy(F.desc("z"), "f"))
    return [r["f"] for r in strong.collect()]


class Voters:
    """Counts of each voter's hits in a text."""

    def __init__(self, lexicon: list[str]):
        self.index = {f: i for i, f in enumerate(lexicon)}
        self.n = len(lexicon)
        self.memo: dict[str, tuple[int, ...]] = {}

    def of_word(self, word: str) -> tuple[int, ...]:
        hit = tuple(self.index[f] for f in features(word) if f in self.index)
        if len(self.memo) > 500_000:
            self.memo.clear()
        self.memo[word] = hit
        return hit

    def hits(self, text: str) -> tuple[dict[int, int], list[float]]:
        """Hits by voter, and the patterns' values."""
        words = text.lower().split()
        get, found = self.memo.get, Counter()
        for w in words:
            hit = get(w)
            if hit is None:
                hit = self.of_word(w)
            if hit:
                found.update(hit)
        n = max(len(words), 1)
        shout = sum(1 for _ in _SHOUT.finditer(text)) / n
        return found, [shout, text.count("!") / n, (words.count("you") + words.count("your")) / n,
                       float(len(words) > 2000), float(not found)]

    def dense(self, hits: list[tuple[dict[int, int], list[float]]], sizes: list[int]):
        """Votes (rows, voters; 1 toxic, -1 clean, 0 none) and classifier inputs."""
        count = np.zeros((len(hits), self.n), np.float64)
        for r, (found, _) in enumerate(hits):
            for i, c in found.items():
                count[r, i] = c
        pat = np.array([p for _, p in hits]).reshape(-1, len(PATTERNS))
        size = np.maximum(np.array(sizes, float), 1)[:, None]
        votes = np.concatenate([(count > 0).astype(np.int8), (pat[:, :3] > [0.2, 0.1, 0.1]).astype(np.int8),
                                -(pat[:, 4:5] > 0).astype(np.int8)], axis=1)
        total = count.sum(axis=1, keepdims=True)
        x = np.concatenate([count > 0, np.log1p(total), np.log1p(1000 * total / size), total > 0,
                            np.minimum(pat, 1)], axis=1).astype(np.float64)
        return votes, x


def label_model(votes: np.ndarray, gold: np.ndarray, weight: np.ndarray, rounds: int = 12) -> np.ndarray:
    """Posterior probability of the toxic class of each row (expectation maximisation)."""
    votes = np.concatenate([votes, np.where(gold > 0, 1, -1)[:, None]], axis=1).astype(np.float32)
    values = np.array([-1, 0, 1])
    parts = [slice(i, i + 256) for i in range(0, votes.shape[1], 256)]  # bounds the temporary arrays
    post = np.where(gold > 0, 0.9, 0.1)
    share = np.ones(votes.shape[1])
    # the classes' shares are the annotator's: else a class could drift over silent rows
    prior = float(np.clip(((gold > 0) * weight).sum() / weight.sum(), 1e-3, 1 - 1e-3))
    for _ in range(rounds):
        llr = np.zeros((votes.shape[1], 3))
        corr = np.zeros((votes.shape[1],) * 2)
        for sign, q in ((1, post), (-1, 1 - post)):
            mass = q * weight
            found = np.concatenate([np.stack([mass @ (votes[:, c] == v) for v in values], 1) for c in parts])
            p = (found + 0.5) / (mass.sum() + 1.5)
            llr += sign * np.log(p)
            mean = (found[:, 2] - found[:, 0]) / max(mass.sum(), 1e-9)
            cov = np.concatenate([(votes[:, c] * mass[:, None]).T @ votes for c in parts]) / max(mass.sum(), 1e-9)
            cov -= np.outer(mean, mean)
            sd = np.sqrt(np.maximum(np.diag(cov), 0)) + 1e-6
            corr += 0.5 * np.abs(cov / np.outer(sd, sd))
        np.fill_diagonal(corr, 1.0)
        share = 1 / (corr * (corr > CORRELATED)).sum(axis=1)  # correlated voters share their weight
        llr[:, 1] = 0.0  # a voter that abstains says nothing
        said = llr * share[:, None]
        logit = math.log(prior / (1 - prior)) + sum((votes[:, c] == v) @ said[c, k] for c in parts for k, v in enumerate(values))
        post = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return post


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 400, l2: float = 1e-3):
    """Weighted logistic regression on soft labels; (coefficients, intercept)."""
    mean, sd = x.mean(axis=0), x.std(axis=0) + 1e-3
    u = (x - mean) / sd
    w, b = np.zeros(x.shape[1]), 0.0
    m, v = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    weight = weight / weight.sum()
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(u @ w + b, -30, 30)))
        d = (p - y) * weight
        g = np.r_[u.T @ d + l2 * w, d.sum()]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        s = 0.05 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-9)
        w, b = w - s[:-1], b - s[-1]
    coef = w / sd
    return coef, float(b - coef @ mean)


def fit(docs: DataFrame, labels: DataFrame, trains: Column, doc_id: str, text: str, label: str):
    """(lexicon, coefficients, intercept), or None without a row of each class."""
    rows = sample(docs, labels, trains, doc_id, text, label)
    per = {r["y"]: (r["n"], r["rate"]) for r in rows.groupBy("y").agg(F.count("*").alias("n"), F.max("rate").alias("rate"))
           .collect()}
    if not {0, 1} <= set(per):
        return None
    (n0, rate0), (n1, rate1) = per[0], per[1]
    lexicon = associated(rows, n1, n0, rate1 / rate0)
    schema = pa.schema([("y", pa.int32()), ("rate", pa.float64()), ("size", pa.int64()),
                        ("voter", pa.list_(pa.int32())), ("count", pa.list_(pa.int32())),
                        ("pattern", pa.list_(pa.float64()))])

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = Voters(lexicon)
        for cols in batched(batches):
            hits = [voters.hits(t or "") for t in cols["t"]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols["y"], pa.int32()), pa.array(cols["rate"]), pa.array([(t or "").count(" ") + 1 for t in cols["t"]]),
                 pa.array([list(f.keys()) for f, _ in hits], pa.list_(pa.int32())),
                 pa.array([list(f.values()) for f, _ in hits], pa.list_(pa.int32())),
                 pa.array([p for _, p in hits], pa.list_(pa.float64()))], schema=schema)

    # bounded: twice PER_CLASS rows of a few numbers
    got = rows.mapInArrow(vote, "y int, rate double, size long, voter array<int>, count array<int>, "
                                "pattern array<double>").collect()
    got = sorted(got, key=lambda r: (r["y"], r["size"], r["voter"], r["count"], r["pattern"]))
    hits = [(dict(zip(r["voter"], r["count"], strict=True)), r["pattern"]) for r in got]
    votes, x = Voters(lexicon).dense(hits, [r["size"] for r in got])
    weight = np.array([1 / r["rate"] for r in got])
    post = label_model(votes, np.array([r["y"] for r in got]), weight)
    coef, intercept = logistic(x, post, weight)
    return lexicon, coef, intercept


def score_column(model, text: str) -> Column:
    """The score of column ``text`` under a model of :func:`fit`."""
    if model is None:
        return F.lit(0.0)
    lexicon, coef, intercept = model

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        voters = Voters(lexicon)
        for series in batches:
            out = [np.empty(0)]
            texts = [t or "" for t in series]
            for i in range(0, len(texts), 512):
                part = texts[i:i + 512]
                x = voters.dense([voters.hits(t) for t in part], [t.count(" ") + 1 for t in part])[1]
                out.append(1 / (1 + np.exp(-np.clip(x @ coef + intercept, -30, 30))))
            yield pd.Series(np.concatenate(out))

    return run(F.col(text))


def score(docs: DataFrame, labels: DataFrame, trains: Column, doc_id: str = "doc_id", text: str = "text",
          label: str = "toxic") -> DataFrame:
    """(doc_id, score, predicted) of every row of ``docs``; ``labels`` has the id and
    ``label`` (0/1), learned where ``trains`` holds."""
    bound_batches(docs.sparkSession)
    model = fit(docs, labels, trains, doc_id, text, label)
    out = docs.select(F.col(doc_id).cast("long").alias("doc_id"), score_column(model, text).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def reject(docs: DataFrame, labels: DataFrame, trains: Column, doc_id: str = "doc_id", text: str = "text",
           label: str = "toxic") -> DataFrame:
    """``docs`` without the rows whose text is predicted toxic; all columns are kept."""
    bound_batches(docs.sparkSession)
    return docs.where(score_column(fit(docs, labels, trains, doc_id, text, label), text) < 0.5)
