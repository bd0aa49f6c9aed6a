"""Forest node tables, lasso paths and keyword vectors against plain versions."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from respan.operators import crossval, forest, gram
from respan.operators import models as MD
from respan.operators import vectors as V


def regression(spark, n, d=3, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.random((n, d))
    y = np.sin(5 * x[:, 0]) + 0.3 * x[:, 1] + 0.1 * rng.random(n)
    rows = [(i, x[i].tolist(), float(y[i])) for i in range(n)]
    return x, y, spark.createDataFrame(rows, "row_id long, x array<double>, y double")


def test_node_table_scores_like_the_library(spark):
    x, _, df = regression(spark, 300)
    rf = MD.rf_estimator("y")
    fitted = rf.fit(MD._vec(df, "x"))
    model = forest.ForestModel(forest.node_table(spark, fitted), 3, 5)
    own = np.array([fitted.predict(Vectors.dense(v)) for v in x])
    assert np.allclose(model.predict(x).mean(axis=1), own)
    assert np.allclose(model.featureImportances.toArray(), fitted.featureImportances.toArray())
    got = model.uncertainty(df, "x", ["row_id"]).orderBy("row_id").toPandas()
    trees = np.array([[t.predict(Vectors.dense(v)) for t in fitted.trees] for v in x])
    assert np.allclose(got.mean_pred, trees.mean(axis=1)) and np.allclose(got.std_pred, trees.std(axis=1, ddof=1))
    assert set(got.n_draws) == {10}


def test_min_samples_split_is_the_size_of_the_node_that_splits(spark):
    # a root of 10 splits into 9 and 1; the node of 9 could split again
    nodes = [(0, 0, 0, 0.5, 1, 4, 10, 1.9, 0.5), (0, 1, 1, 0.5, 2, 3, 9, 1.0, 0.1), (0, 2, -1, 0.0, -1, -1, 5, 0.5, -1.0),
             (0, 3, -1, 0.0, -1, -1, 4, 1.6, -1.0), (0, 4, -1, 0.0, -1, -1, 1, 10.0, -1.0)]
    table = __import__("pandas").DataFrame(nodes, columns=forest.COLUMNS)
    xs = np.array([[0.1, 0.1], [0.1, 0.9], [0.9, 0.1]])
    assert forest.ForestModel(table, 2, 2, 9).predict(xs)[:, 0].tolist() == [0.5, 1.6, 10.0]
    assert forest.ForestModel(table, 2, 2, 10).predict(xs)[:, 0].tolist() == [1.0, 1.0, 10.0]
    assert forest.ForestModel(table, 2, 2, 11).predict(xs)[:, 0].tolist() == [1.9, 1.9, 1.9]
    assert forest.ForestModel(table, 2, 2, 10).featureImportances.toArray().tolist() == [1.0, 0.0]
    # fitted: no node under the threshold splits, some child is under half of it
    _, _, df = regression(spark, 200, seed=3)
    model = MD.fit(df, "rf", "x", "y", {"min_samples_split": 30, "max_depth": 7})
    inner = model.nodes[(model.nodes.feature >= 0) & model._reached()]
    assert inner["count"].min() >= 30
    children = [model.nodes.iloc[[model.left[i], model.right[i]]]["count"].min() for i in inner.index]
    assert min(children) < 15


def test_lasso_path_is_optimal_for_every_feature():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((80, 12)) @ rng.standard_normal((12, 12))
    x[:, 5] = 2.0  # no variance
    y = x[:, 0] - 2 * x[:, 3] + rng.standard_normal(80) + 4
    z = np.concatenate([x, np.ones((80, 1)), y[:, None]], axis=1)
    alphas = [0.01, 1.0, 0.1, 100.0]
    path = gram.lasso_path(z.T @ z, alphas)
    for i, a in enumerate(alphas):
        w, b = path[:-1, i], path[-1, i]
        g = (x - x.mean(axis=0)).T @ (y - x @ w - b) / 80
        assert np.allclose(g[w != 0], a * np.sign(w[w != 0]), atol=1e-8) and (np.abs(g[w == 0]) <= a + 1e-8).all()
        assert abs((y - x @ w - b).mean()) < 1e-9 and w[5] == 0
        assert gram.lasso_residual(z.T @ z, path[:, i], a).max() < 1e-8
    assert not path[:-1, 3].any()


@pytest.mark.parametrize("kind", ["lasso", "ridge"])
def test_fold_scores_are_those_of_separate_fits(spark, kind):
    x, y, df = regression(spark, 120, seed=5)
    folded = crossval.stratified_folds(df, "row_id", "y", 4)
    got = {(r.fold, r.alpha, r.metric): r for r in gram.cross_validate_path(folded, "x", "y", [0.05, 0.2], kind).collect()}
    fold = np.array([r.fold for r in folded.orderBy("row_id").collect()])
    assert len(got) == 4 * 2 * 3 and max(r.optimality for r in got.values()) < 1e-9
    for k in range(4):
        tr = fold != k
        z = np.concatenate([x[tr], np.ones((tr.sum(), 1)), y[tr, None]], axis=1)
        for a in (0.05, 0.2):
            m = gram.lasso_path(z.T @ z, [a])[:, 0] if kind == "lasso" else gram.ridge(z.T @ z, a)
            for rows, score in ((tr, "train_score"), (~tr, "test_score")):
                e = y[rows] - x[rows] @ m[:-1] - m[-1]
                want = {"mse": (e * e).mean(), "mae": np.abs(e).mean(), "r2": 1 - (e @ e) / ((y[rows] - y[rows].mean()) ** 2).sum()}
                for metric, v in want.items():
                    assert np.isclose(got[k, a, metric][score], v)


def test_keyword_vectors_cover_all_tokens_and_layers(spark):
    edges = spark.createDataFrame([(1, 0, 0, 2, 0, 0.5), (1, 0, 0, 2, 0, 0.7), (1, 0, 1, 2, 1, 0.4), (1, 1, 0, 3, 2, 0.9), (1, 2, 0, 0, 1, 1.0),
                                   (2, 0, 0, 0, 0, 1.0)], "doc long, layer int, head int, from_pos int, to_pos int, weight double")
    first = spark.createDataFrame([(1, "from", 2), (2, "to", 0), (3, "to", 0)], "doc long, keyword string, pos int")
    lengths = spark.createDataFrame([(1, 4), (2, 1), (3, 2)], "doc long, n_tokens int")
    got = {(r.doc, r.layer): (r.attention_from, r.attention_to) for r in V.keyword_vectors(edges, first, lengths).collect()}
    assert got == {(1, 0): ([0.3, 0.2, 0.0, 0.0], [0.0] * 4), (1, 1): ([0.0] * 4, [0.0, 0.0, 0.0, 0.9]), (1, 2): ([0.0] * 4, [0.0] * 4),
                   (2, 0): ([1.0], [1.0])}
    means = {(r.doc, r.layer): (r.mean_from, r.mean_to) for r in V.keyword_layers(edges, first, lengths).collect()}
    assert means[1, 0] == (0.125, 0.0) and means[1, 1] == (0.0, 0.225) and means[1, 2] == (0.0, 0.0) and len(means) == 4
    tokens = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "from"), (1, 3, "c"), (2, 0, "to")], "doc long, pos int, token string")
    top = V.keyword_top_tokens(edges, first, tokens, 3).where("doc = 1 and direction = 'from'").orderBy("rank").collect()
    assert [(r.pos, r.token, r.attention) for r in top] == [(0, "a", 0.0), (1, "b", 0.0), (2, "from", 0.0)]  # last layer: no edge touches it
