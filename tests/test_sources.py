"""Listings in tasks, logs read from their ends, nested pairs, encoder ladder."""

import random

import numpy as np
import pandas as pd
import pytest

from respan.operators import vectors as V
from respan.sources import files, scans


# ---------------------------------------------------------------- logs
def last_lines(data: bytes, keys):
    out, at = {}, 0
    for line in data.split(b"\n"):
        for k in keys:
            if k.encode() in line:
                out[k] = (at, line.rstrip(b"\r").decode("utf-8", "replace"))
        at += len(line) + 1
    return out


def test_last_matches_equal_a_forward_read():
    rng = random.Random(2)
    words = ["val_mse", "val_mae: ", "x", "é日", "", "Training completed in 3 s", "\r"]
    for _ in range(400):
        data = "\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(0, 12))).encode()
        keys = ["val_mse", "val_mae", "completed in", "never"]
        for block in (1, 2, 7, 64):
            got = files.last_matches(lambda a, n, data=data: data[a:a + n], len(data), keys, block)
            assert got == last_lines(data, keys), (data, block)


def test_a_long_log_is_read_only_as_far_as_needed():
    data = b"val_r2: 0\n" + b"noise\n" * 100_000 + b"val_mse: 1\nval_mae: 2\n"
    asked = []

    def read(a, n):
        asked.append(n)
        return data[a:a + n]
    assert files.last_matches(read, len(data), ["val_mse", "val_mae"], 4096)["val_mae"][1] == "val_mae: 2"
    assert asked == [4096]
    assert files.last_matches(read, len(data), ["val_r2"], 4096)["val_r2"] == (0, "val_r2: 0")


def test_scan_log_metrics(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.log").write_text("val_mse of fold: 1: 2.5\nTraining completed in 12.5 s\nval_mse: 3\n")
    (tmp_path / "sub" / "b.log").write_text("val_mse 7\n")
    (tmp_path / "c.log").write_text("val_mse: 9\n")
    (tmp_path / "d.log").write_text("")
    (tmp_path / "other.txt").write_text("val_mse: 1\n")
    failed = spark.createDataFrame([("c.log",)], "file string")
    got = {(r.file, r.key): (r.value, r.offset) for r in files.scan_log_metrics(spark, str(tmp_path), ["val_mse", "completed"], failed=failed).collect()}
    assert got == {("a.log", "val_mse"): ("3", 53), ("a.log", "completed"): ("12.5 s", 24), ("b.log", "val_mse"): ("", 0),
                   ("b.log", "completed"): ("N/A", None), ("c.log", "val_mse"): ("N/A", None), ("c.log", "completed"): ("N/A", None),
                   ("d.log", "val_mse"): ("N/A", None), ("d.log", "completed"): ("N/A", None)}


# ---------------------------------------------------------------- nested pairs
def nest(root):
    def put(path, text):
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text, encoding="utf-8")
    put("generated__A.tpcm/generated__A.tpcm", "doc ä")
    put("generated__A.tpcm/x/Usage_Scenario_2.csv", "h\n1")
    put("generated__A.tpcm/x/Usage_Scenario_1.csv", "h\r\n2\r\n")
    put("generated__B.tpcm/generated__B.tpcm", "doc")
    put("generated__B.tpcm/Usage_Scenario_1.csv", "h\n")  # header only, though the next one has rows
    put("generated__B.tpcm/Usage_Scenario_2.csv", "h\n1\n")
    put("generated__C.tpcm/Usage_Scenario_1.csv", "h\n1\n")
    put("generated__D.tpcm/generated__D.tpcm", "")
    put("generated__E.tpcm/generated__E.tpcm", "doc")
    put("generated__E.tpcm/Usage_Scenario_1.csv", "")
    put("generated__F.tpcm/generated__F.tpcm", "f")
    put("generated__F.tpcm/Usage_Scenario_1.csv", "\n\n")
    put("ignored/generated__G.tpcm", "doc")


def test_pairs_are_found_staged_and_committed(spark, tmp_path):
    root = tmp_path / "PCMs"
    nest(root)
    found = scans.find_pairs(spark, str(root))
    assert {r.model[-1]: r.status for r in found.collect()} == {"A": "pair", "B": "header only", "C": "no document", "D": "no measurements",
                                                               "E": "header only", "F": "pair"}
    out = str(tmp_path / "out")
    pairs = found.where("status = 'pair'").drop("status")
    # a pair whose CSV vanishes between the listing and the copy leaves nothing behind
    rows = [*map(tuple, pairs.collect()), ("generated__Z", str(root / "generated__A.tpcm/generated__A.tpcm"), str(root / "gone.csv"))]
    scans.stage_pairs(spark.createDataFrame(rows, "model string, doc_path string, csv_path string"), out)
    got = {r.model: (r.doc_text, r.csv_text) for r in scans.read_pairs(spark, out).collect()}
    assert got == {"generated__A": ("doc ä", "h\r\n2\r\n"), "generated__F": ("f", "\n\n")}
    manifest = spark.read.parquet(f"{out}/manifest").toPandas().set_index("model")
    assert manifest.loc["generated__Z", "error"] and manifest.loc["generated__Z", "doc_file"] is None
    assert not list((tmp_path / "out").rglob("*__Z*"))


def test_a_missing_root_has_no_pairs_and_listings_go_down(spark, tmp_path):
    assert scans.find_pairs(spark, str(tmp_path / "none")).count() == 0
    nest(tmp_path)
    names = {r.path.rsplit("/", 1)[-1] for r in files.list_files(spark, str(tmp_path), "Usage*.csv").collect()}
    assert names == {"Usage_Scenario_1.csv", "Usage_Scenario_2.csv"}
    assert files.list_artefacts(spark, str(tmp_path)).where("name = 'generated__D.tpcm'").first().length == 0


# ---------------------------------------------------------------- encoder
def encoder(bad):
    def make():
        def encode(texts):
            if any(b in t for t in texts for b in bad):
                raise ValueError("no")
            return [[float(len(t)), 1.0] for t in texts]
        return encode
    return make


def test_failing_texts_are_isolated_by_bisection():
    calls = []

    def encode(texts):
        calls.append(list(texts))
        if "x" in texts:
            raise ValueError("no")
        return [[len(t)] for t in texts]
    vecs, errors = V.encode_in_parts(encode, ["a", "bb", "x", "ccc", "x", "d"], 4)
    assert [None if v is None else v[0] for v in vecs] == [1, 2, None, 3, None, 1]
    assert [e is not None for e in errors] == [False, False, True, False, True, False] and len(calls) < 12
    vecs, errors = V.encode_in_parts(lambda t: [[1.0]], ["a", "b"], 2)  # a wrong number of vectors is a failure of the call
    assert [v is not None for v in vecs] == [True, True] and errors == [None, None]


def test_encode_documents_ladder(spark):
    long = " ".join(["good"] * 458 + ["bad"] + ["good"] * 457 + ["fine"] * 10)
    rows = [(1, "two words"), (2, None), (3, "  "), (4, long), (5, "bad " * 3), (6, "!!"), (7, "ok " * 600 + "bad"), (8, "w" * 2000 + " bad")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = V.encode_documents(d, encoder(["bad"])).toPandas().set_index("doc_id")
    assert got.level.to_dict() == {1: "chunks", 2: "blank", 3: "blank", 4: "chunks", 5: "failed", 6: "chunks", 7: "chunks", 8: "first_1000"}
    assert got.n_chunks.to_dict()[4] == 3 and got.n_failed.to_dict()[4] == 1 and got.n_failed.to_dict()[7] == 1
    first, last = "good " * 457 + "good", "fine " * 9 + "fine"
    want = np.mean([[len(t), 1] / np.linalg.norm([len(t), 1]) for t in (first, last)], axis=0)
    assert np.allclose(got.vec[4], want / np.linalg.norm(want))
    assert got.vec[5] is None and pd.isna(got.dim[5]) and "no" in got.error[5] and got.dim[1] == 2
    assert got.token_count.to_dict()[6] == 0 and got.file_size_bytes[8] == 2004 and got.timestamp.notna().all()
    assert np.allclose(got.vec[2], np.array([1, 1]) / np.sqrt(2))
    zero = V.encode_documents(d, encoder(["bad"]), blank="zero", dim=2).toPandas().set_index("doc_id")
    assert not any(zero.vec[2]) and not any(zero.vec[5]) and zero.level[5] == "failed"
    with pytest.raises(ValueError):
        V.encode_documents(d, encoder([]), blank="zero")
