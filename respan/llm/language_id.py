"""Language identification: a bidirectional gated recurrent network over bytes.

Two recurrent passes (left to right, right to left) read windows of :data:`WINDOW`
bytes; a softmax over both states labels every byte position, and a document's
probabilities are the mean over all its positions.  The network is trained in numpy by
backpropagation through time on a bounded sample of labelled documents
(:data:`PER_LANG` windows a language); prediction reads whole texts inside Spark tasks.

Defined cases: a null text or one without a letter is ``und`` with score 0; with no
labelled training row every document is ``und``; ties go to the alphabetically first
language; repeated rows are predicted alike; extra columns are ignored; very long texts
are read window by window.  A null language never trains.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from respan.llm import gru
from respan.llm.util import batched, bound_batches

#: Bytes of one window; the states start at zero in each.
WINDOW = 128
HIDDEN = 8
#: Bound of the training sample: windows of labelled documents a language.
PER_LANG = 3000
EPOCHS, LANES, RATE = 6, 128, 0.01
#: Windows that run side by side when predicting.
PREDICT_LANES = 4096
UNDEFINED = "und"


def training_sample(docs: DataFrame, trains: Column, doc_id: str, text: str, lang: str,
                    per_lang: int = PER_LANG, window: int = WINDOW) -> list[tuple[str, bytes]]:
    """At most ``per_lang`` (language, window) pairs a language, chosen by a hash of the
    id; one window at a hashed place of each chosen text."""
    rows = docs.where(trains & F.col(lang).isNotNull() & (F.length(text) > 0))
    counts = {r[lang]: r["count"] for r in rows.groupBy(lang).count().collect()}
    rate = F.lit(0.0)
    for k, n in counts.items():
        rate = F.when(F.col(lang) == F.lit(k), F.lit(1.2 * per_lang / n)).otherwise(rate)
    h = F.xxhash64(F.col(doc_id).cast("string"), F.lit("language sample"))
    u = F.pmod(h, F.lit(1 << 30)) / F.lit(float(1 << 30))
    at = F.pmod(F.xxhash64(h), F.greatest(F.length(text) - F.lit(window), F.lit(1))) + F.lit(1)
    picked = (rows.select(F.col(lang).alias("k"), h.alias("h"), rate.alias("rate"), u.alias("u"),
                          F.substring(F.col(text), at.cast("int"), F.lit(window)).alias("w"))
              .where(F.col("u") < F.col("rate")).select("k", "h", "w").collect())
    seen: dict[str, int] = {}
    out = []
    for r in sorted(picked, key=lambda r: (r.k, r.h, r.w)):
        seen[r.k] = seen.get(r.k, 0) + 1
        if seen[r.k] <= per_lang:
            out.append((r.k, r.w.encode()[:window].ljust(window)))
    return out


def train(sample: list[tuple[str, bytes]], hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = 7) -> dict | None:
    """Fit the network; ``None`` without rows."""
    if not sample:
        return None
    rng = np.random.default_rng(seed)
    langs = sorted({k for k, _ in sample})
    x = np.array([np.frombuffer(w, np.uint8) for _, w in sample]).T.copy()
    y = np.array([langs.index(k) for k, _ in sample])
    # every language weighs alike, however many rows it has
    per = np.bincount(y, minlength=len(langs))
    weight = (len(y) / (len(langs) * per))[y].astype(np.float32)
    p = {}
    for d in "fb":
        p |= {f"{d}{k}": v for k, v in gru.init(hidden, 256, rng).items()}
        p[f"{d}V"] = rng.normal(0, 0.3, (len(langs), hidden)).astype(np.float32)
    p["bias"] = np.zeros((len(langs), 1), np.float32)
    opt = gru.Adam(p, RATE)
    steps = max(epochs * -(-len(y) // LANES), 150)
    order: np.ndarray = np.empty(0, np.int64)
    for i in range(steps):
        if len(order) < LANES:
            order = np.concatenate([order, rng.permutation(len(y))])
        at, order = order[:LANES], order[LANES:]
        xb, grads = x[:, at], {}
        runs = {}
        logits = np.broadcast_to(p["bias"], (WINDOW, len(langs), len(at))).copy()
        for d, xd in (("f", xb), ("b", xb[::-1])):
            cell = {"U": p[f"{d}U"], "W": p[f"{d}W"]}
            states, tape = gru.forward(cell, xd, np.zeros((hidden, len(at)), np.float32))
            runs[d] = (cell, xd, states, tape)
            logits += (p[f"{d}V"] @ states)[:: 1 if d == "f" else -1]
        dl = gru.softmax(logits, 1)
        dl[:, y[at], np.arange(len(at))] -= 1
        dl *= weight[at] / (len(at) * WINDOW / 8)
        grads["bias"] = dl.sum(axis=(0, 2))[:, None]
        for d, (cell, xd, states, tape) in runs.items():
            dd = dl if d == "f" else dl[::-1]
            grads[f"{d}V"] = np.einsum("tlb,thb->lh", dd, states, optimize=True)
            back = gru.backward(cell, xd, tape, np.ascontiguousarray(p[f"{d}V"].T @ dd))
            grads |= {f"{d}{k}": v for k, v in back.items()}
        opt.update(grads, scale=max(0.05, 1 - i / steps))
    return p | {"langs": langs}


def position_probabilities(model: dict, x: np.ndarray) -> np.ndarray:
    """Label probabilities (T, languages, lanes) at every byte of windows (T, lanes)."""
    hidden, lanes = model["fW"].shape[1], x.shape[1]
    logits = np.empty((len(x), len(model["langs"]), lanes), np.float32)
    logits[:] = model["bias"]
    cols = np.empty((3 * hidden, lanes), np.float32)
    for d in "fb":
        u, w, v = model[f"{d}U"], model[f"{d}W"], model[f"{d}V"]
        h = np.zeros((hidden, lanes), np.float32)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            np.take(u, x[t], axis=1, out=cols, mode="clip")
            h = gru.step(cols, w, h)
            logits[t] += v @ h
    np.clip(logits, -30, 30, out=logits)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits


def pooled(model: dict, texts: list[bytes]) -> np.ndarray:
    """Mean label probabilities (documents, languages) over all positions of each text."""
    sizes = np.array([len(b) for b in texts], np.int64)
    buffer = np.frombuffer(b"".join(b if len(b) >= WINDOW else b.ljust(WINDOW) for b in texts), np.uint8)
    begin = np.concatenate([[0], np.cumsum(np.maximum(sizes, WINDOW))[:-1]])
    n_win = np.maximum(-(-sizes // WINDOW), 1)
    owner = np.repeat(np.arange(len(texts)), n_win)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(n_win) - n_win, n_win)
    # the last window ends with the text, so it may overlap the one before it; every
    # position counts once
    start = np.minimum(k * WINDOW, np.maximum(sizes[owner] - WINDOW, 0))
    lo, hi = k * WINDOW - start, np.minimum(sizes[owner], WINDOW)
    out = np.zeros((len(texts), len(model["langs"])))
    pos = np.arange(WINDOW)[:, None]
    for i in range(0, len(owner), PREDICT_LANES):
        s = slice(i, i + PREDICT_LANES)
        x = buffer[(begin[owner[s]] + start[s])[None, :] + pos]
        probs = position_probabilities(model, x)
        odd = np.flatnonzero((lo[s] > 0) | (hi[s] < WINDOW))
        if len(odd):
            probs[:, :, odd] *= ((pos >= lo[s][odd]) & (pos < hi[s][odd]))[:, None, :]
        np.add.at(out, owner[s], probs.sum(axis=0).T)
    return out / np.maximum(sizes, 1)[:, None]


def identify(docs: DataFrame, trains: Column, doc_id: str = "doc_id", text: str = "text",
             lang: str = "lang") -> DataFrame:
    """(doc_id, lang_pred, score) for every row; ``trains`` is the condition under which
    a row's language may be learned."""
    bound_batches(docs.sparkSession)
    model = train(training_sample(docs, trains, doc_id, text, lang))
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in batched(batches):
            texts = cols["t"]
            use = [i for i, t in enumerate(texts) if model and t and any(map(str.isalpha, t))]
            pred, score = [UNDEFINED] * len(texts), [0.0] * len(texts)
            if use:
                probs = pooled(model, [texts[i].encode() for i in use])
                for i, row in zip(use, probs, strict=True):
                    best = int(row.argmax())
                    pred[i], score[i] = model["langs"][best], float(min(row[best], 1.0))
            yield pa.RecordBatch.from_arrays([pa.array(cols["d"], pa.int64()), pa.array(pred, pa.string()),
                                              pa.array(score, pa.float64())], schema=schema)

    rows = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t"))
    return rows.mapInArrow(predict, "doc_id long, lang_pred string, score double")
