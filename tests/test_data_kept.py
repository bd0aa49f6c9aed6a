"""Nothing is lost: odd files, empty documents, boundary rows; fits against closed forms."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from respan.operators import gram as G
from respan.operators import metrics as M
from respan.operators import runs as R
from respan.operators import svr
from respan.operators import text as T
from respan.operators import vectors as V
from respan.operators.split import exact_split, sizes_70_15_15
from respan.sources import scans as SC


def test_measurements_keep_scientific_notation_and_short_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text('"Point in Time[s]",note,Response Time[s]\n1.0E-4,"x,y",2.5e-05\n7\n3,n,1.5\n')
    (tmp_path / "b.csv").write_text("Response Time[s]\n1E3\n")
    (tmp_path / "c.csv").write_text("Point in Time[s]\n5\n")
    (tmp_path / "d.csv").write_text("Point in Time[s],Response Time[s]\n")
    rows = {(r.base_name, r.point_in_time, r.response_time) for r in SC.scan_measurements(spark, str(tmp_path)).collect()}
    assert rows == {("a", 1e-4, 2.5e-5), ("a", 7.0, None), ("a", 3.0, 1.5), ("b", None, 1000.0)}


def test_documents_keep_empty_files_and_odd_names(spark, tmp_path):
    (tmp_path / "empty.tpcm").write_text("")
    (tmp_path / "a b+c.tpcm").write_text("one")
    rows = {r.base_name: (r.tpcm_text, r.file_size_bytes) for r in SC.scan_documents(spark, str(tmp_path)).collect()}
    assert rows == {"empty": ("", 0), "a b+c": ("one", 3)}
    docs = spark.createDataFrame([("a b:c%d", "text")], "base_name string, tpcm_text string")
    SC.write_documents(docs, str(tmp_path / "out"))
    back = SC.scan_documents(spark, str(tmp_path / "out"), glob="*.txt", strip_sep="\n").collect()
    assert [(r.base_name, r.tpcm_text) for r in back] == [("a b:c%d", "text")]


def test_pairs_choose_the_first_csv_then_test_it(spark, tmp_path):
    for name, files in {"X": {"b/Usage_Scenario2.csv": "h\n1\n", "a/Usage_Scenario1.csv": "h\n"}, "Y": {"Usage_Scenario.csv": "h\n1"}}.items():
        d = tmp_path / f"generated__{name}.tpcm"
        d.mkdir()
        (d / f"generated__{name}.tpcm").write_text(name)
        for f, t in files.items():
            (d / f).parent.mkdir(exist_ok=True)
            (d / f).write_text(t)
    pairs = SC.collect_pairs(spark, str(tmp_path))
    assert [(r.model, r.doc_text, r.csv_text) for r in pairs.collect()] == [("generated__Y", "Y", "h\n1")]
    SC.write_pairs(pairs, str(tmp_path / "pairs"))
    assert spark.read.parquet(str(tmp_path / "pairs")).count() == 1


def test_chunks_and_vectors_keep_every_document(spark):
    long = " ".join(f"word{i}" for i in range(7000))
    docs = spark.createDataFrame([(1, "some words here"), (2, ""), (3, "! ?"), (4, None), (5, long)], "doc_id long, text string")
    chunks = T.chunk_table(docs, "plain")
    total = {r.doc_id: r.n for r in chunks.groupBy("doc_id").agg(F.sum(F.coalesce(F.size("tokens"), F.lit(0))).alias("n")).collect()}
    assert total == {1: 3, 2: 0, 3: 0, 4: 0, 5: 7000}
    for how in ("mean", "first_last", "weighted"):
        pooled = V.pool_chunks(V.hash_encode_chunks(chunks), how).toPandas()
        assert set(pooled.doc_id) == {1, 2, 3, 4, 5}
        assert (pooled[pooled.doc_id.isin([2, 3, 4])].value == 0).all()


def test_cancelling_chunk_still_counts(spark):
    rows = [(1, 3, 0, 0, 1.0), (1, 3, 1, 0, 0.0), (1, 3, 2, 1, 1.0)]
    v = spark.createDataFrame(rows, "doc_id long, n_chunks int, chunk_idx int, dim int, value double")
    out = {r.dim: r.value for r in V.pool_chunks(v, "weighted").collect()}
    expect = np.array([1.5, 1.3]) / np.hypot(1.5, 1.3)
    assert np.allclose([out[0], out[1]], expect)


def test_split_boundaries_with_sixteen_buckets(spark):
    df = spark.range(0, 1037).withColumnRenamed("id", "k")
    fine = {r.k: r.split for r in exact_split(df, ["k"]).collect()}
    coarse = {r.k: r.split for r in exact_split(df, ["k"], digits=1).collect()}
    assert fine == coarse
    assert [list(coarse.values()).count(s) for s in ("train", "val", "test")] == sizes_70_15_15(1037)
    twins = spark.createDataFrame([(i // 50,) for i in range(500)], "k long")  # equal keys on both sides of a cut
    got = exact_split(twins, ["k"], digits=1).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == dict(zip(("train", "val", "test"), sizes_70_15_15(500)))


def test_poisson_weights_have_no_cut():
    assert abs(M.POISSON1_CDF[6] - 0.999916758850712) < 1e-12 and 1 - M.POISSON1_CDF[-1] < 2.0 ** -33


def test_run_scan_has_no_default_limit(spark):
    runs = spark.range(0, 10050).select(F.col("id").cast("string").alias("run_id"),
                                        F.create_map(F.lit("model_type"), F.lit("rf")).alias("params"),
                                        F.create_map(F.lit("m"), F.col("id").cast("double")).alias("metrics"))
    assert R.scan_runs(runs, "rf", "m").count() == 10050 and R.scan_runs(runs, "rf", max_results=5).count() == 5


def test_target_patterns_never_leak():
    cols = ["a", "response_time", "time_of_day", "b"]
    assert R.detect_target(cols) == "response_time" and R.feature_columns(cols) == ["a", "b"]


def _frame(spark, n=400, d=5, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    y = x @ np.arange(1, d + 1) + 2 + 0.1 * rng.normal(size=n)
    return x, y, spark.createDataFrame([(i, [float(v) for v in r], float(t), i % 4) for i, (r, t) in enumerate(zip(x, y))],
                                       "row_id long, x array<double>, y double, fold int").repartition(3)


def test_cross_validation_and_learning_curve_equal_the_closed_form(spark):
    x, y, df = _frame(spark)

    def fit(rows):
        xc, yc = x[rows] - x[rows].mean(0), y[rows] - y[rows].mean()
        w = np.linalg.solve(xc.T @ xc + np.eye(5), xc.T @ yc)
        return w, y[rows].mean() - x[rows].mean(0) @ w

    got = G.cross_validate_ridge(df, "x", "y").toPandas().set_index(["fold", "metric"])
    for k in range(4):
        rows = np.arange(400) % 4 != k
        w, b = fit(rows)
        e = y[~rows] - x[~rows] @ w - b
        assert np.isclose(got.loc[(k, "mse"), "test_score"], (e * e).mean())
        assert np.isclose(got.loc[(k, "mae"), "test_score"], np.abs(e).mean())
    curve = G.learning_curve_ridge(df, {"all": df}, "x", "y", "row_id", [0.1, 0.5, 1.0]).toPandas()
    for f, n in ((0.1, 40), (0.5, 200), (1.0, 400)):
        rows = np.arange(400) < n
        w, b = fit(rows)
        part = curve[(curve.fraction == f) & (curve.metric == "mse")].set_index("split").value
        assert np.isclose(part["train"], ((y[rows] - x[rows] @ w - b) ** 2).mean())
        assert np.isclose(part["all"], ((y - x @ w - b) ** 2).mean())


def test_svr_reaches_the_objective(spark):
    x, y, df = _frame(spark, 200, 3)

    def objective(w, b, C, eps):
        return 0.5 * w @ w + C * np.maximum(0, np.abs(y - x @ w - b) - eps).sum()

    m = svr.fit_svr(df, "x", "y", C=1.0, epsilon=0.1, kernel="linear")
    ours = objective(m.w, m.b, 1.0, 0.1)
    rng = np.random.default_rng(0)
    for scale in (1e-2, 1e-3):
        for _ in range(200):
            assert objective(m.w + scale * rng.normal(size=3), m.b + scale * rng.normal(), 1.0, 0.1) > ours - 2e-2 * ours
    out = m.transform(df, "x").toPandas()
    assert ((out.y - out.yhat) ** 2).mean() < 0.02 * out.y.var()


def test_running_best_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 7)
    rng = np.random.default_rng(5)
    t = pd.DataFrame({"study": ["a"] * 60, "number": np.arange(60), "value": rng.normal(size=60)})
    t.loc[::9, "value"] = None
    got = R.best_so_far(spark.createDataFrame(t).withColumn("value", F.expr("nanvl(value, null)"))).toPandas().sort_values("number")
    assert np.allclose(got.best_so_far.to_numpy(float)[1:], t.value.cummin().ffill().to_numpy()[1:])
