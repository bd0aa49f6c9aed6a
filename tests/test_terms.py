"""Packed term units against plain counting."""

import math
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from respan.operators import terms
from respan.operators import text as T

#: Rows that share a key or have none, in and outside the training set; empty, null and one-word texts.
ROWS = [(1, "train", "aa bb aa bb cc"), (1, "train", "bb aa"), (1, "val", "aa dd"), (None, "train", "aa bb éé_1"), (None, "train", "cc aa"),
        (2, "val", "zz zz bb"), (3, "train", ""), (4, "train", None), (5, "train", "cc"), (6, "test", "aa bb"), (7, "train", "aa BB x cc")]


def expected(rows, split_of_train="train", min_df=2):
    counts = {}
    for k, s, t in rows:
        w = re.findall(r"\w{2,}", (t or "").lower())
        counts.setdefault((k, s), Counter()).update([*w, *map(" ".join, zip(w, w[1:], strict=False))])
    train = [c for (_, s), c in counts.items() if s == split_of_train]
    n = sum(s == split_of_train for _, s, _ in rows)
    df = {t: f for t, f in Counter(t for c in train for t in c).items() if f >= min_df}
    idf = {t: math.log((1 + n) / (1 + f)) + 1 for t, f in df.items()}
    out = {}
    for (k, s), c in counts.items():
        w = {t: (1 + math.log(f)) * idf[t] for t, f in c.items() if t in idf}
        norm = math.sqrt(sum(x * x for x in w.values()))
        out |= {(k, s, t): x / norm for t, x in w.items()}
    return idf, out


def rows_of(df):
    return {(r.doc_id, r.split, r.term): r.weight for r in df.collect()}


@pytest.mark.parametrize(("unit", "units_a_bucket"), [(1 << 20, 4), (8, 1)])
def test_weights_of_units_are_those_of_plain_counts(spark, monkeypatch, unit, units_a_bucket):
    monkeypatch.setattr(terms, "UNIT_TEXT", unit)
    monkeypatch.setattr(terms, "BUCKET_UNITS", units_a_bucket)
    monkeypatch.setattr(terms, "HANDED_ROWS", 3)
    docs = spark.createDataFrame(ROWS, "doc_id long, split string, text string").repartition(3)
    idf, want = expected(ROWS)
    model, got = T.fit_transform_tfidf(docs, F.col("split") == "train", keep=["split"])
    assert {r.term: r.idf for r in model.collect()} == pytest.approx(idf)
    assert got.columns == ["doc_id", "split", "term", "weight"] and rows_of(got) == pytest.approx(want) and got.count() == len(want)
    packed = T.packed_terms(docs, F.col("split") == "train", keep=["split"])
    for train in (True, False):
        some = {k: v for k, v in want.items() if (k[1] == "train") == train}
        assert rows_of(packed.weights(["doc_id", "split"], train)) == pytest.approx(some)
    assert {(r.term, r.df) for r in T.fit_tfidf(docs.where("split = 'train'")).collect()} == {(r.term, r.df) for r in model.collect()}


def test_a_bounded_vocabulary_and_rows_without_any_term(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, split string, text string")
    model, got = T.fit_transform_tfidf(docs, F.col("split") == "train", keep=["split"], max_features=2)
    assert {r.term for r in model.collect()} == {"aa", "bb"} == {r.term for r in got.collect()}
    model, got = T.fit_transform_tfidf(docs.where("doc_id = 3"), F.col("split") == "train")
    assert model.count() == 0 and got.count() == 0
    model, got = T.fit_transform_tfidf(docs.limit(0), F.lit(True))
    assert model.count() == 0 and got.count() == 0


def test_rows_of_documents_and_terms_are_neither_stored_nor_shuffled(spark):
    """They are several times as large as the texts."""
    rng = np.random.default_rng(3)
    words = np.array([f"word{i:04d}" for i in range(2000)])
    rows = [(i, " ".join(words[(rng.random(300) ** 3 * 2000).astype(int)])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    before = set(folder.rglob("*"))
    _, got = T.fit_transform_tfidf(docs, F.col("doc_id") % 10 < 7)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    written = sum(f.stat().st_size for f in set(folder.rglob("*")) - before if f.is_file() and not f.name.endswith(".crc"))
    assert got.count() > 60_000 and written < 0.6 * sum(len(t) for _, t in rows), written


def test_numbers_and_strings_come_back():
    for a in (np.array([0, -5, 2 ** 31 - 1], np.int32), np.array([2 ** 40, -1]), np.zeros(0, np.int32)):
        assert np.array_equal(terms._numbers(terms._squeezed(a), a.dtype), a)
    s = pa.array(["", "é", "two words", ""] * 5)
    for part in (s, s.slice(3, 4), s.slice(0, 1), s.slice(0, 0)):
        assert terms._strings(terms._strings_out(part)).equals(part)
