"""Unit tests: edge rules, closed forms and brute-force twins of the distributed operators."""

import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from respan.functions.quantiles import exact_percentiles
from respan.operators import metrics as M
from respan.operators import pruning
from respan.operators import runs as R
from respan.operators.split import exact_split, sizes_70_15_15


def test_split_sizes_exact(spark):
    df = spark.range(0, 1037).withColumnRenamed("id", "k")
    out = exact_split(df, ["k"]).groupBy("split").count().toPandas().set_index("split")["count"].to_dict()
    assert [out["train"], out["val"], out["test"]] == sizes_70_15_15(1037)
    assert sum(out.values()) == 1037


def test_split_deterministic(spark):
    df = spark.range(0, 500).withColumnRenamed("id", "k")
    a = exact_split(df, ["k"]).orderBy("k").toPandas()
    b = exact_split(df.repartition(7), ["k"]).orderBy("k").toPandas()
    assert (a["split"] == b["split"]).all()


@pytest.mark.parametrize("heavy", [False, True])
def test_exact_percentiles_match_numpy(spark, heavy):
    rng = np.random.default_rng(1)
    v = rng.normal(size=3000)
    if heavy:  # one value holding a third of the rows
        v[:1000] = 0.25
    g = np.repeat(["a", "b", "c"], 1000)
    pdf = pd.DataFrame({"g": g, "v": v})
    probs = [0.01, 0.25, 0.5, 0.75, 0.99]
    out = exact_percentiles(spark.createDataFrame(pdf), "v", probs, ["g"], buckets=16).toPandas().set_index("g")
    for grp, sub in pdf.groupby("g"):
        expect = np.percentile(sub["v"], [p * 100 for p in probs])
        got = out.loc[grp, [f"p_{i}" for i in range(len(probs))]].to_numpy(dtype=float)
        assert np.allclose(got, expect, rtol=0, atol=1e-12)


def test_r2_constant_target(spark):
    df = spark.createDataFrame(pd.DataFrame({"y": [2.0, 2.0, 2.0], "yhat": [2.0, 2.0, 2.0]}))
    assert M.regression_metrics(df).first()["r2"] == 1.0
    df2 = spark.createDataFrame(pd.DataFrame({"y": [2.0, 2.0, 2.0], "yhat": [1.0, 2.0, 3.0]}))
    assert M.regression_metrics(df2).first()["r2"] == 0.0


def test_mape_absent_and_capped(spark):
    tiny = spark.createDataFrame(pd.DataFrame({"y": [1e-7, -1e-7, 1e-7], "yhat": [1.0, 1.0, 1.0]}))
    r = M.regression_metrics(tiny).first()
    assert r["mape"] is None
    big = spark.createDataFrame(pd.DataFrame({"y": [0.001, 0.002], "yhat": [10.0, 10.0]}))
    assert M.regression_metrics(big).first()["mape"] == 1000.0


def test_std_null_for_single_row_group(spark):
    df = spark.createDataFrame(pd.DataFrame({"p": ["a"], "v": ["1"], "m": ["x"], "metric_value": [1.0],
                                             "normalize_targets": [True]}))
    out = R.param_effect_series(df, ["p", "v", "m"]).first()
    assert out["std_norm"] == 0.0 and out["mean_raw"] is None


def test_parse_run_name_quirk_and_fix(spark):
    df = spark.createDataFrame([("learning_rate=0.1_model=torch_emb=bert_norm=true_run2",)], "run_name string")
    quirk = df.select(R.parse_run_name(F.col("run_name")).alias("m")).first()["m"]
    assert quirk["rate"] == "0.1" and "learning_rate" not in quirk and quirk["emb"] == "bert"
    fixed = df.select(R.parse_run_name(F.col("run_name"), ["learning_rate"]).alias("m")).first()["m"]
    assert fixed["learning_rate"] == "0.1"


def test_running_median_matches_bruteforce(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"study": "s", "number": rng.permutation(200), "step": 1, "value": rng.normal(size=200)})
    out = pruning.earlier_values(spark.createDataFrame(pdf)).orderBy("number").toPandas()
    ordered = pdf.sort_values("number")["value"].to_numpy()
    for i, row in enumerate(out.itertuples()):
        assert (row.n_before, row.n_less) == (i, (ordered[:i] < ordered[i]).sum())
        if i and 2 * row.n_less == i:  # the median lies between the neighbours
            assert abs((row.below + row.above) / 2 - np.median(ordered[:i])) < 1e-12


def test_bootstrap_reproducible(spark):
    pdf = pd.DataFrame({"row_id": np.arange(300), "g": "a", "y": np.linspace(0, 10, 300)})
    pdf["yhat"] = pdf["y"] + np.sin(pdf["row_id"])
    df = spark.createDataFrame(pdf)
    a = M.bootstrap_ci(df, ["g"], n_boot=50).orderBy("metric").toPandas()
    b = M.bootstrap_ci(df.repartition(5), ["g"], n_boot=50).orderBy("metric").toPandas()
    assert np.allclose(a["ci_lower"], b["ci_lower"]) and (a["ci_lower"] <= a["ci_upper"]).all()


def test_ridge_matches_closed_form(spark):
    from respan.operators import models as MD
    rng = np.random.default_rng(0)
    X = rng.normal(size=(200, 5))
    y = X @ np.array([1.0, -2.0, 0.5, 0.0, 3.0]) + rng.normal(size=200) + 4.0
    df = spark.createDataFrame([(row.tolist(), float(t)) for row, t in zip(X, y)], "x array<double>, y double")
    m = MD.fit(df, "ridge", "x", "y", {"alpha": 1.0})
    Xc, yc = X - X.mean(0), y - y.mean()
    w = np.linalg.solve(Xc.T @ Xc + 1.0 * np.eye(5), Xc.T @ yc)
    assert np.allclose(m.coefficients.toArray(), w, atol=1e-6)


def test_ridge_1d_closed_form(spark):
    from respan.operators import models as MD
    rng = np.random.default_rng(2)
    x = rng.normal(size=100)
    y = 2 * x + rng.normal(size=100)
    r = MD.ridge_1d(spark.createDataFrame(pd.DataFrame({"x": x, "y": y})), "x", "y", 1.0).first()
    xc, yc = x - x.mean(), y - y.mean()
    assert abs(r["w"] - (xc @ yc) / (xc @ xc + 1.0)) < 1e-9


def test_scan_documents_and_collect_pairs(spark, tmp_path):
    from respan.sources.scans import collect_pairs, scan_documents, scan_measurements
    d = tmp_path / "dsl"
    d.mkdir()
    (d / "model_1.tpcm").write_text("component A\nprovides B\n", encoding="utf-8")
    (d / "model_2.tpcm").write_text("", encoding="utf-8")
    docs = scan_documents(spark, str(d)).orderBy("base_name").toPandas()
    assert list(docs["base_name"]) == ["model_1", "model_2"]
    assert docs["tpcm_text"][0] == "component A\nprovides B\n"
    m = tmp_path / "meas"
    m.mkdir()
    (m / "model_1.csv").write_text("Response Time[s],Point in Time[s]\n1.5,0.0\n2.5,1.0\n", encoding="utf-8")
    (m / "model_2.csv").write_text("Point in Time[s]\n0.0\n", encoding="utf-8")  # column missing -> skipped
    (m / "model_3.csv").write_text("Point in Time[s],Response Time[s]\n", encoding="utf-8")  # header only
    rows = scan_measurements(spark, str(m)).toPandas()
    assert set(rows["base_name"]) == {"model_1"} and sorted(rows["response_time"]) == [1.5, 2.5]
    root = tmp_path / "PCMs"
    a = root / "generated__A.tpcm"
    (a / "sub").mkdir(parents=True)
    (a / "generated__A.tpcm").write_text("x", encoding="utf-8")
    (a / "sub" / "Usage_Scenario_1.csv").write_text("h\n1\n", encoding="utf-8")
    b = root / "generated__B.tpcm"
    b.mkdir()
    (b / "generated__B.tpcm").write_text("y", encoding="utf-8")
    (b / "Usage_Scenario_x.csv").write_text("h", encoding="utf-8")  # header only -> dropped
    pairs = collect_pairs(spark, str(root)).toPandas()
    assert list(pairs["model"]) == ["generated__A"]


def test_bootstrap_vectorised_equals_sql(spark):
    pdf = pd.DataFrame({"row_id": np.arange(500), "g": np.where(np.arange(500) % 2 == 0, "a", "b"),
                        "y": np.linspace(0, 10, 500)})
    pdf["yhat"] = pdf["y"] + np.cos(pdf["row_id"])
    df = spark.createDataFrame(pdf)
    a = M.bootstrap_ci(df, ["g"], n_boot=64, vectorised=True).orderBy("g", "metric").toPandas()
    b = M.bootstrap_ci(df, ["g"], n_boot=64, vectorised=False).orderBy("g", "metric").toPandas()
    assert np.allclose(a["ci_lower"], b["ci_lower"], atol=1e-10)
    assert np.allclose(a["ci_upper"], b["ci_upper"], atol=1e-10)


@pytest.mark.parametrize("grouped", [True, False])
def test_exact_percentiles_refinement(spark, grouped):
    rng = np.random.default_rng(7)
    v = rng.normal(size=2000)
    v[:300] = 1.5  # tie block
    pdf = pd.DataFrame({"g": np.where(np.arange(2000) % 2 == 0, "a", "b"), "v": v})
    probs = [0.05, 0.5, 0.9]
    groups = ["g"] if grouped else []
    out = exact_percentiles(spark.createDataFrame(pdf), "v", probs, groups, buckets=4,
                            ).toPandas()
    cols = [f"p_{i}" for i in range(len(probs))]
    if grouped:
        out = out.set_index("g")
        for grp, sub in pdf.groupby("g"):
            assert np.allclose(out.loc[grp, cols].to_numpy(float), np.percentile(sub["v"], [5, 50, 90]), atol=1e-12)
    else:
        assert np.allclose(out[cols].to_numpy(float)[0], np.percentile(pdf["v"], [5, 50, 90]), atol=1e-12)
