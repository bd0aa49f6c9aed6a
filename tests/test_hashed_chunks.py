"""Chunk vectors from tokens hashed in tasks."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from respan.operators import text as T
from respan.operators import vectors as V
from respan.streaming import pending


def signs(tokens, dim=64):
    v = np.zeros(dim)
    for t in tokens:
        h = int(hashlib.md5(t.encode()).hexdigest()[:5], 16)
        v[h // 16 % dim] += 1 if h % 16 % 2 == 0 else -1
    return v


def test_sums_are_those_of_single_tokens():
    lists = [["aa", "bb", "aa"], [], None, ["é日", None], ["x"] * 9, [None]]
    row, at, value = V._hashed(pa.array([["skipped"], *lists], pa.list_(pa.string())).slice(1), 64)
    got = np.zeros((len(lists), 64))
    got[row, at] = value
    assert np.array_equal(got, [signs(t for t in x or [] if t is not None) for x in lists])
    assert set(row) == set(range(len(lists))) and [(a, v) for r, a, v in zip(row, at, value, strict=True) if r in (1, 2, 5)] == [(0, 0.0)] * 3


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_of_a_key_are_one_document_and_one_shuffle_serves_the_pooling(spark, monkeypatch):
    monkeypatch.setattr(V, "HASHED_ROWS", 2)
    rows = [(1, "aa bb cc"), (1, "bb dd"), (None, "aa"), (None, "ee aa"), (2, ""), (3, None), (4, " ".join(f"w{i}" for i in range(1000)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    pooled = V.pool_chunks(V.hash_encode_chunks(T.chunk_table(docs, "plain")), "mean")
    got = {}
    for r in pooled.collect():
        got.setdefault(r.doc_id, np.zeros(64))[r.dim] = r.value
    unit = lambda v: v / (np.linalg.norm(v) or 1.0)
    w = [f"w{i}" for i in range(1000)]
    want = {1: unit(signs("aa bb cc bb dd".split())), None: unit(signs("aa ee aa".split())), 2: np.zeros(64), 3: np.zeros(64),
            4: unit(sum(unit(signs(w[a:a + 458])) for a in range(0, 1000, 458)) / 3)}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    assert plan(V.pool_chunks(V.hash_encode_chunks(T.chunk_table(plain, "plain")), "mean")).count("Exchange ") == 1


def test_the_stream_opens_each_file_in_one_task_and_passes_all_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pending, "FILES_PER_BATCH", 4)
    monkeypatch.setattr(pending, "FILES_KEPT", 40)
    folder = tmp_path / "a+b %41"
    folder.mkdir()
    for i in range(10):
        (folder / f"d{i}.txt").write_bytes(b"some words \xff of bytes\n" if i == 3 else f"aa bb{i}\nlast\n".encode())
    read = []
    monkeypatch.setattr(pending, "read_files", lambda files, root, f=pending.read_files: read.append(1) or f(files, root))
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    assert pending.embed_new_documents(spark, str(folder), out, ck) == 10 and len(read) == 3
    got = {r.base_name: (r.token_count, r.file_size_bytes) for r in spark.read.parquet(out).collect()}
    assert got == {f"d{i}": (4, 23) if i == 3 else (3, 11) for i in range(10)}
    assert spark.read.parquet(out).where(F.size("vec") == 0).count() == 0
