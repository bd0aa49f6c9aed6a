"""Token-id files, fill-in-middle and periodic runs against plain versions, and on nulls, empty,
long, tied and repeated rows, empty tables and extra columns with clashing names."""

import collections
import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from respan.llm import fim, periodic, pfor, queries, token_ids
from respan.llm.util import tokenizer_path
from respan.session import scratch_path
from tests.conftest import SF_SMALL
from tests.llm import brute

RNG = random.Random(11)
LONG = " ".join(f"wörd{i % 977} e{i}" for i in range(20000))
LOOP = " ".join(["tick", "tock", "boom"] * 9000 + ["end"])
ROWS = [(3, "One two. Three,  four"), (1, None), (2, ""), (2, ""), (4, " \t\n "), (5, "日本語の文章です。😀 mixed"), (6, "a <|endoftext|> b"),
        (7, "has <P> in it"), (8, LONG), (9, "a a a a a a b"), (9, "a a a a a a b"), (9, "tied id"), (None, "x y x y x y x y"),
        (None, None), (10, LOOP), (11, "tail   space  "), (12, "\r\n don't  stop't 12,000 €5"), (13, "x" * 5000), (14, "\x00 nul")]
PATH = tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    clash = ("d", "t", "hash", "number", "ids", "start", "n", "h", "g", "a", "p", "words", "form", "output", "runs", "collapsed", "partition")
    return df.select("*", *[F.lit(f"x{i}").alias(c) for i, c in enumerate(clash)])


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


# ---------------------------------------------------------------- token-id files
@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=700), st.integers(0, 40))
def test_blocks_round_trip(values, width):
    ids = np.array([v & ((1 << width) - 1) if i % 7 else v for i, v in enumerate(values)], np.uint32)
    data, start = pfor.encode_blocks(ids)
    assert (pfor.decode_blocks(data, start)[:len(ids)] == ids).all()
    assert len(start) == -(-len(ids) // pfor.BLOCK)


def test_width_is_the_percentile_and_outliers_are_exceptions():
    ids = np.full(pfor.BLOCK, 1000, np.uint32) + np.arange(pfor.BLOCK, dtype=np.uint32) % 8
    ids[::16] = 50_000  # 16 of 256
    data, _ = pfor.encode_blocks(ids)
    assert data[4:6] == bytes([3, 16]) and len(data) == pfor.HEAD + 32 * 3 + 5 * 16


def expected_ids(rows):
    """Rows in file order: (doc_id, start, ids); equal ids in any order have equal totals."""
    ids = brute.token_ids([t for _, t in rows], PATH)
    return {(d, t): i for (d, t), i in zip(rows, ids, strict=True)}


def test_token_files(spark, docs, empty):
    path = scratch_path(spark, "token-files-test")
    out = token_ids.through_files(docs, PATH, path)
    got = sorted(out.collect(), key=lambda r: r.start)
    want = expected_ids(ROWS)
    key = lambda d: (d is not None, d)
    assert [key(r.doc_id) for r in got] == sorted(key(d) for d, _ in ROWS)
    at = 0
    for r in got:
        assert (r.start, r.n_tokens, len(r.ids)) == (at, r.n_tokens, 4 * r.n_tokens)
        at += r.n_tokens
    ids = [(r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got]
    assert collections.Counter(ids) == collections.Counter((d, tuple(want[d, t])) for d, t in ROWS)
    token_ids.write_ids(token_ids.encode(token_ids.ordered(docs), PATH), path + "-ids")  # the same from a table of ids
    assert sorted(map(tuple, token_ids.read_ids(spark, path + "-ids").select("start", "ids").collect())) == [(r.start, r.ids) for r in got]
    # one span of one file through its block index
    names = [r.name for r in spark.read.option("multiLine", True).json(f"{path}/manifest.json").selectExpr("inline(files)").collect()]
    whole = token_ids.read_span(f"{path}/{names[0]}", 0, 10**9)
    for a, n in ((0, 1), (255, 2), (256, 256), (len(whole) - 1, 5), (len(whole), 3), (300, 700)):
        assert (token_ids.read_span(f"{path}/{names[0]}", a, n) == whole[a:a + n]).all()
    none = token_ids.through_files(empty, PATH)
    assert none.columns == out.columns and none.count() == 0


def test_ids_of_a_whole_table_are_the_librarys(spark):
    got = queries.QUERIES["op11_token_ids"](spark, SF_SMALL).orderBy("doc_id").collect()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").orderBy("doc_id").collect()]
    at = 0
    for g, (d, _), ids in zip(got, rows, brute.token_ids([t for _, t in rows], PATH), strict=True):
        assert tuple(g) == (d, at, len(ids), brute.crc_ids(ids))
        at += len(ids)


def test_many_files_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(token_ids, "LEAST", 1 << 12)
    rows = [(i, " ".join(RNG.choice(("alpha", "βeta", "gamma7", "δ,")) for _ in range(RNG.randint(0, 400)))) for i in range(300)]
    rows += [(7, "copied row")] * 200
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(token_ids.through_files(df, PATH).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(d for d, _ in rows)
    want = expected_ids(rows)
    assert sum(r.n_tokens for r in got) == sum(len(want[r]) for r in rows)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:], strict=False))
    assert token_ids.ordered(df).rdd.getNumPartitions() > 4


def test_a_cut_file_is_refused(tmp_path):
    (tmp_path / "bad").write_bytes(b"RSPFOR01" + bytes(60))
    with pytest.raises(ValueError):
        token_ids.read_span(str(tmp_path / "bad"), 0, 1)


# ---------------------------------------------------------------- fill-in-middle
@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=90))
def test_fenwick_prefix_and_descent(counts):
    tree, total = fim.Fenwick(np.array(counts, np.int64)), np.concatenate([[0], np.cumsum(counts)]).astype(int)
    assert [tree.prefix(i) for i in range(len(counts) + 1)] == total.tolist()
    for k in range(int(total[-1]) + 2):
        at = int(np.flatnonzero(total <= k)[-1])
        assert tree.descend(k) == (at, k - total[at])


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("abZ <PS>M1é日😀\n "), max_size=120), st.integers(0, 10**6), st.sampled_from((1, 3, 8, 1024)))
def test_transform_text(text, doc_id, block):
    n, form, p, m, out = fim.transform_text(doc_id, text.encode(), block=block)
    assert (n, form, p, m, out.decode()) == brute.fim(doc_id, text)


def test_transform_and_restore(spark, docs, empty):
    out = fim.transform(docs).withColumn("back", fim.restored(F.col("form"), F.col("output")))
    got = out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "back").collect()
    want = [(d, *brute.fim(d, t), t or "") for d, t in ROWS]
    assert collections.Counter(map(tuple, got)) == collections.Counter(want)
    assert {"psm", "spm"} <= {r.form for r in fim.transform(docs, rate=100, spm=50).collect()}
    assert {r.form for r in fim.transform(docs, rate=0).collect()} == {"plain"}
    assert fim.transform(empty).count() == 0


# ---------------------------------------------------------------- periodic runs
def sequences():
    for _ in range(250):
        w = [RNG.randrange(RNG.choice((1, 2, 3, 8))) for _ in range(RNG.choice((0, 1, 5, 6, 7, 20, 60, 120)))]
        if w and RNG.random() < 0.6:
            a = RNG.randrange(len(w))
            p = 1 + RNG.randrange(max(1, (len(w) - a) // 3))
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        yield w * RNG.choice((1, 1, 3))


def test_periodic_runs_of_many_sequences_at_once():
    lines = list(sequences())
    codes = np.array([c for w in lines for c in w], np.int64)
    doc = np.repeat(np.arange(len(lines)), [len(w) for w in lines])
    got = list(zip(*(x.tolist() for x in periodic.periodic_runs(codes, doc)), strict=True))
    want, at = [], 0
    for w in lines:
        want += [(s + at, n, q) for s, n, q in brute.periodic_runs(w)]
        at += len(w)
    assert got == want and len(want) > 100


def collapse(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_find_runs(spark, docs, empty):
    got = periodic.find_runs(docs).collect()
    want = []
    for d, t in ROWS:
        w = [x.decode() for x in brute.words(t)]
        runs = [(0, 27000, 3)] if t == LOOP else [] if t == LONG else brute.periodic_runs(w)
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        want.append((d, len(w), tuple(runs), best, collapse(w, runs)))
    rows = [(r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.greatest and tuple(r.greatest), r.collapsed) for r in got]
    assert collections.Counter(rows) == collections.Counter(want)
    assert periodic.find_runs(empty).count() == 0


def test_query_of_periodic_runs(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op13_periodic_runs"](spark, SF_SMALL).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    found = 0
    for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect():
        w = [x.decode() for x in brute.words(r.text)]
        h, n = brute.zlib.crc32(str(r.doc_id).encode()), len(w)
        if h % 10 == 0 and n:
            a, g = h // 10 % n, h // 10
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        elif n > 400:
            continue  # the plain version takes the square of the words
        runs = brute.periodic_runs(w)
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=(None,) * 3)
        row = got[r.doc_id]
        assert (row.n_runs, row.start, row.length, row.period) == (len(runs), *best)
        assert row.exponent_milli == (best[1] * 1000 // best[2] if runs else None)
        assert row.runs_sha256 == sha("".join(f"{s},{m},{q}\n" for s, m, q in runs))
        assert row.collapsed_sha256 == sha(collapse(w, runs))
        found += len(runs)
    assert found > 5 and len(got) == 200
