"""Registered queries: target scaling, closed-form fits, learning curves, search
spaces (checked against SQL) and MLlib fits (rows-only checks)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from respan import catalog as C
from respan.catalog import with_fixtures
from respan.functions.hashing import sql_hash_hex, sql_uniform
from respan.operators import forest
from respan.operators import models as MD
from respan.operators.metrics import regression_metrics
from respan.operators.split import exact_split, split_sql
from respan.plans.evaluation_queries import _SAMPLES_SQL, _samples
from respan.plans.registry import r6, register


def _fx(body: str, *names: str, extra: str = "") -> str:
    if not names:
        return ("WITH " + extra.strip() + "\n" + body) if extra else body
    sql = with_fixtures("", *names)
    if extra:
        sql = sql.rstrip() + ",\n" + extra.strip() + "\n"
    return sql + body


_SCALE_SQL = _SAMPLES_SQL + ", sp AS (" + split_sql("samples", ["base_name"]) + """),
st AS (SELECT avg(avg_resp_time) AS m, coalesce(nullif(stddev_pop(avg_resp_time), 0), 1.0) AS s FROM sp WHERE split = 'train')
"""


def _scaled(spark, sf):
    s = exact_split(_samples(spark, sf), ["base_name"])
    sc = MD.target_scaler(s.where(F.col("split") == "train"), "avg_resp_time")
    return MD.scale_targets(s, "avg_resp_time", sc), sc


@register("scale_targets", _fx(
    f"SELECT base_name, split, {r6('(avg_resp_time - m) / s', 'y_scaled')} FROM sp, st", "dsl_docs", "measurements",
    extra=_SCALE_SQL))
def q_scale_targets(spark, sf):
    """M1: standardise with train mean / population std (constant target -> scale 1)."""
    d, _ = _scaled(spark, sf)
    return d.select("base_name", "split", "y_scaled")


@register("unscale_predictions", _fx(
    f"SELECT base_name, {r6('((avg_resp_time - m) / s) * s + m', 'y_back')} FROM sp, st", "dsl_docs", "measurements",
    extra=_SCALE_SQL))
def q_unscale(spark, sf):
    d, sc = _scaled(spark, sf)
    return MD.unscale(d, "y_scaled", sc, "y_back").select("base_name", "y_back")


_FEAT_SQL = "fs AS (" + split_sql("(SELECT row_id, x[1] AS x1, target AS y FROM features)", ["row_id"]) + ")"


def _feat_split(spark, sf):
    f = C.features(spark, sf).select("row_id", "x", F.element_at("x", 1).alias("x1"), F.col("target").alias("y"))
    return exact_split(f, ["row_id"])


@register("ridge_1d", _fx(
    """SELECT """ + r6("w", "w") + ", " + r6("(sy - w * sx) / n", "b") + """, n FROM (
         SELECT n, sx, sy, ((sxy - sx * sy / n) / ((sxx - sx * sx / n) + 1.0)) AS w FROM (
           SELECT count(*) AS n, sum(x1) AS sx, sum(y) AS sy, sum(x1 * x1) AS sxx, sum(x1 * y) AS sxy
           FROM fs WHERE split = 'train'))""", "features", extra=_FEAT_SQL))
def q_ridge_1d(spark, sf):
    d = _feat_split(spark, sf)
    return MD.ridge_1d(d.where(F.col("split") == "train"), "x1", "y", 1.0)


_FR = "[0.1, 0.2, 0.4, 0.6, 0.8, 1.0]"
_LC_SQL = _FEAT_SQL + f""",
tr AS (SELECT *, row_number() OVER (ORDER BY {sql_hash_hex('row_id')}, row_id) - 1 AS rk FROM fs WHERE split = 'train'),
fr AS (SELECT unnest({_FR}) AS fraction),
nf AS (SELECT fraction, greatest(10, CAST(floor(fraction * (SELECT count(*) FROM tr)) AS BIGINT)) AS n_f FROM fr),
pref AS (SELECT tr.*, nf.fraction, nf.n_f FROM tr JOIN nf ON tr.rk < nf.n_f),
lp AS (SELECT fraction, n, w, (sy - w * sx) / n AS b FROM (
         SELECT fraction, count(*) AS n, sum(x1) AS sx, sum(y) AS sy,
                ((sum(x1 * y) - sum(x1) * sum(y) / count(*)) / ((sum(x1 * x1) - sum(x1) * sum(x1) / count(*)) + 1.0)) AS w
         FROM pref GROUP BY fraction))
"""


@register("learning_curve_samples", _fx(
    f"SELECT fraction, CAST(n_f AS INTEGER) AS n_f, count(*) AS n_rows, {r6('sum(y)', 'sum_y')} FROM pref GROUP BY fraction, n_f",
    "features", extra=_LC_SQL))
def q_lc_samples(spark, sf):
    tr = _feat_split(spark, sf).where(F.col("split") == "train")
    p = MD.learning_curve_samples(tr, "row_id")
    return p.groupBy("fraction", "n_f").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("y").alias("sum_y"))


@register("learning_curve", _fx(
    f"""SELECT lp.fraction, lp.n, {r6('t.train_mse', 'train_mse')}, {r6('v.val_mse', 'val_mse')} FROM lp
        JOIN (SELECT p.fraction, avg((p.y - (lp.w * p.x1 + lp.b)) ^ 2) AS train_mse FROM pref p JOIN lp USING (fraction) GROUP BY p.fraction) t USING (fraction)
        JOIN (SELECT lp.fraction, avg((f.y - (lp.w * f.x1 + lp.b)) ^ 2) AS val_mse FROM fs f, lp WHERE f.split = 'val' GROUP BY lp.fraction) v USING (fraction)""",
    "features", extra=_LC_SQL))
def q_learning_curve(spark, sf):
    d = _feat_split(spark, sf)
    return MD.learning_curve(d.where(F.col("split") == "train"), d.where(F.col("split") == "val"), "row_id", "x1", "y")


@register("learning_curve_ridge", _fx(
    """SELECT CAST(fraction AS DOUBLE) AS fraction, CAST(n_f AS INTEGER) AS n, split, metric, true AS sane FROM nf,
         (SELECT unnest(['train', 'val', 'test']) AS split), (SELECT unnest(['mse', 'mae', 'r2']) AS metric)""",
    "features", extra=_LC_SQL))
def q_learning_curve_ridge(spark, sf):
    """M16 on all 64 features: metrics of train, validation and test for each prefix; on train
    the error is at most that of the mean."""
    from respan.operators.gram import learning_curve_ridge
    d = _feat_split(spark, sf)
    ranked = MD._global_hash_rank(d.where(F.col("split") == "train"), "row_id", 42)
    out = learning_curve_ridge(ranked, {k: d.where(F.col("split") == k) for k in ("val", "test")}, "x", "y", "_rank",
                               MD.LEARNING_CURVE_FRACTIONS)
    ok = F.when((F.col("split") == "train") & (F.col("metric") == "r2"), F.col("value") >= -1e-9).otherwise(
        (F.col("metric") == "r2") | (F.col("value") >= 0))
    return out.select("fraction", "n", "split", "metric", ok.alias("sane"))


_DRAWS_SQL = """
dr AS (SELECT model, row_id, yhat + ((row_id * (d + 3)) % 17 - 8) / 10.0 AS pred FROM model_predictions, range(0, 10) t(d))
"""


def _draws(spark, sf):
    p = C.model_predictions(spark, sf)
    d = p.select("model", "row_id", "yhat", F.explode(F.sequence(F.lit(0), F.lit(MD.UNCERTAINTY_DRAWS - 1))).alias("d"))
    return d.select("model", "row_id", (F.col("yhat") + ((F.col("row_id") * (F.col("d") + 3)) % 17 - 8) / 10.0).alias("pred"))


@register("predictive_uncertainty", _fx(
    f"SELECT model, row_id, {r6('avg(pred)', 'mean_pred')}, {r6('stddev_samp(pred)', 'std_pred')}, count(*) AS n_draws FROM dr GROUP BY model, row_id",
    "model_predictions", extra=_DRAWS_SQL))
def q_uncertainty(spark, sf):
    """M8 on a table of draws, all models."""
    return MD.predictive_uncertainty(_draws(spark, sf), ["model", "row_id"])


@register("ensemble_uncertainty", _fx(
    "SELECT row_id, CAST(10 AS BIGINT) AS n_draws, true AS same_mean, true AS same_std FROM features", "features"))
def q_ensemble_uncertainty(spark, sf):
    """M8 from the members of a fitted forest, over all rows, against the predictions that the
    library's own trees give one by one."""
    tr, _ = _xy(spark, sf)
    rf = MD.rf_estimator("y")
    fitted = rf.fit(MD._vec(tr, "x"))
    model = forest.ForestModel(forest.node_table(spark, fitted), fitted.numFeatures, rf.getMaxDepth())
    rows = MD._vec(C.features(spark, sf).select("row_id", "x"), "x")
    for i, tree in enumerate(fitted.trees):
        rows = tree.setPredictionCol(f"p{i}").transform(rows)
    own = F.array(*[f"p{i}" for i in range(len(fitted.trees))])
    out = model.uncertainty(rows.select("row_id", "x", own.alias("own")), "x", ["row_id", "own"])
    mean = F.aggregate("own", F.lit(0.0), lambda a, v: a + v) / F.size("own")
    out = out.withColumn("mean", mean)
    squares = F.aggregate(F.transform("own", lambda v: (v - F.col("mean")) ** 2), F.lit(0.0), lambda a, v: a + v)
    std = F.sqrt(squares / (F.size("own") - 1))
    return out.select("row_id", "n_draws", (F.abs(F.col("mean_pred") - F.col("mean")) < 1e-9).alias("same_mean"),
                      (F.abs(F.col("std_pred") - std) < 1e-9).alias("same_std"))


def _u(salt: str) -> str:
    return sql_uniform("study", "number", f"'{salt}'")


@register("search_space", _fx(
    f"""SELECT study, number,
         ([5, 10, 20])[CAST(floor({_u('n_estimators')} * 3) + 1 AS INTEGER)] AS n_estimators,
         ([3, 5, 7])[CAST(floor({_u('max_depth')} * 3) + 1 AS INTEGER)] AS max_depth,
         CAST(2 + floor({_u('min_samples_split')} * 9) AS INTEGER) AS min_samples_split,
         CAST(1 + floor({_u('min_samples_leaf')} * 5) AS INTEGER) AS min_samples_leaf,
         {r6(f"exp({float(np.log(1e-5))!r} + {_u('alpha')} * {float(np.log(10.0) - np.log(1e-5))!r})", 'alpha')}
       FROM (SELECT DISTINCT study, number FROM trials)""", "trials"))
def q_search_space(spark, sf):
    return MD.search_space(C.trials(spark, sf))


# ---------------------------------------------------------------- rows-only (MLlib / iterative)

def _xy(spark, sf):
    d = _feat_split(spark, sf)
    return d.where(F.col("split") == "train"), d.where(F.col("split") == "val")


_OPTIMAL_SQL = "SELECT CAST(i AS INTEGER) AS feature, true AS optimal FROM range(0, 64) t(i)"


def _residual_products(model, tr):
    """Sum of residual * feature over the training rows, by feature (one aggregate)."""
    s = MD.score(model, tr, "x").select((F.col("y") - F.col("yhat")).alias("r"), F.posexplode("x").alias("feature", "v"))
    return s.groupBy("feature").agg(F.sum(F.col("r") * F.col("v")).alias("g"), F.count(F.lit(1)).alias("n"))


def _coefficients(spark, model):
    return spark.createDataFrame([(i, float(c)) for i, c in enumerate(model.coefficients.toArray())], "feature int, coef double")


@register("ridge_fit", _OPTIMAL_SQL)
def q_ridge_fit(spark, sf):
    """M2: Ridge(alpha=1) on the 64-dim features: the normal equation x'(y - Xw - b) = alpha w
    holds for each feature."""
    tr, _ = _xy(spark, sf)
    m = MD.fit(tr, "ridge", "x", "y", {"alpha": 1.0})
    g = _residual_products(m, tr).join(_coefficients(spark, m), "feature")
    return g.select("feature", (F.abs(F.col("g") - F.col("coef")) < 1e-6 * F.greatest(F.lit(1.0), F.abs("coef"))).alias("optimal"))


@register("lasso_fit", _OPTIMAL_SQL)
def q_lasso_fit(spark, sf):
    """M3: Lasso(alpha=0.01): subgradient optimality for each feature - the mean product of
    residual and feature is alpha times the sign of a coefficient, within alpha at zero."""
    tr, _ = _xy(spark, sf)
    m = MD.fit(tr, "lasso", "x", "y", {"alpha": 0.01})
    g = _residual_products(m, tr).join(_coefficients(spark, m), "feature").withColumn("g", F.col("g") / F.col("n"))
    ok = F.when(F.col("coef") != 0, F.abs(F.col("g") - 0.01 * F.signum("coef")) < 2e-4).otherwise(F.abs("g") <= 0.01 + 2e-4)
    return g.select("feature", ok.alias("optimal"))


def _beats_mean(scored):
    """n, and whether the model's MSE is below that of the rows' mean."""
    return scored.agg(F.count(F.lit(1)).alias("n"),
                      (F.avg((F.col("y") - F.col("yhat")) ** 2) < F.var_pop("y")).alias("beats_mean"))


_BEATS_SQL = _fx("SELECT count(*) AS n, true AS beats_mean FROM fs WHERE split = 'train'", "features", extra=_FEAT_SQL)


@register("rf_fit", _BEATS_SQL)
def q_rf_fit(spark, sf):
    tr, _ = _xy(spark, sf)
    return _beats_mean(MD.score(MD.fit(tr, "rf", "x", "y", dict(MD.RF_DEFAULTS)), tr, "x"))


@register("svr_fit", _BEATS_SQL)
def q_svr_fit(spark, sf):
    """M5: linear kernel on the 64 features; explains training rows better than their mean
    (validation quality is in fit_score_all)."""
    tr, _ = _xy(spark, sf)
    return _beats_mean(MD.score(MD.fit(tr, "svm", "x", "y", {"kernel": "linear"}), tr, "x"))


@register("fit_score_all", _fx(
    """SELECT model, split, count(*) AS n, true AS finite FROM fs, (SELECT unnest(['ridge', 'lasso', 'rf', 'svm']) AS model)
       WHERE split <> 'train' GROUP BY model, split""", "features", extra=_FEAT_SQL))
def q_fit_score_all(spark, sf):
    """M6/M7: fit each model kind on train, score val and test, metrics per kind/split."""
    d = _feat_split(spark, sf)
    tr = d.where(F.col("split") == "train")
    out = None
    for kind in ["ridge", "lasso", "rf", "svm"]:
        m = MD.fit(tr, kind, "x", "y", {"alpha": 0.01} if kind == "lasso" else None)
        met = regression_metrics(MD.score(m, d.where(F.col("split") != "train"), "x"), ["split"], relative=False)
        met = met.select(F.lit(kind).alias("model"), "split", "n", (F.col("mse") >= 0).alias("finite"))
        out = met if out is None else out.unionByName(met)
    return out


@register("score_batches", _fx("SELECT row_id, true AS agrees FROM features", "features"))
def q_score_batches(spark, sf):
    """M7: a fitted model's own predict(X) applied batch-wise with mapInPandas gives what
    the distributed transform gives."""
    tr, _ = _xy(spark, sf)
    m = MD.fit(tr, "ridge", "x", "y")
    coef, intercept = m.coefficients.toArray(), float(m.intercept)

    def make():
        return lambda X: X @ coef + intercept
    f = MD.score(m, C.features(spark, sf), "x", "expected")
    out = MD.predict_with(f, make, "x", keep=["row_id", "expected"])
    return out.select("row_id", (F.abs(F.col("yhat") - F.col("expected")) < 1e-9).alias("agrees"))


#: Trials of one study in the registered search.
_SEARCH_TRIALS = 6


@register("hyperparameter_search", _fx(
    f"""SELECT kind, CAST(t AS INTEGER) AS trial, true AS fitted, t = 0 AND false AS is_worst_than_best
        FROM range(0, {_SEARCH_TRIALS}) r(t), (SELECT unnest(['rf', 'ridge', 'lasso']) AS kind)""", "features"))
def q_hyper_search(spark, sf):
    """The hash-seeded search space for forest, ridge and lasso, on validation MSE."""
    tr, va = _xy(spark, sf)
    tr, va = tr.cache(), va.cache()
    numbers = spark.range(_SEARCH_TRIALS).select(F.lit("study").alias("study"), F.col("id").alias("number"))
    configs = [r.asDict() for r in MD.search_space(numbers).orderBy("number").collect()]
    found = MD.hyperparameter_search(tr, va, "x", "y", configs)
    best = found.agg(F.min("objective").alias("b")).first()["b"]
    tr.unpersist()
    va.unpersist()
    return found.select("kind", "trial", F.col("error").isNull().alias("fitted"), (F.col("objective") < best).alias("is_worst_than_best"))


@register("pca_projection", _fx("SELECT count(*) AS n, true AS uncorrelated, true AS ordered FROM features", "features"))
def q_pca(spark, sf):
    """Two components over all rows: uncorrelated, the first with the larger variance."""
    proj, _ = MD.pca_projection(C.features(spark, sf), "x", 2)
    a, b = F.element_at("pc", 1), F.element_at("pc", 2)
    return proj.agg(F.count(F.lit(1)).alias("n"), (F.abs(F.corr(a, b)) < 1e-6).alias("uncorrelated"),
                    (F.var_pop(a) >= F.var_pop(b)).alias("ordered"))


@register("cumulative_variance", "SELECT CAST(i AS BIGINT) AS component, true AS decreasing, true AS adds_up FROM range(1, 65) t(i)")
def q_cumvar(spark, sf):
    """Ratios of all 64 components fall, and their running sums reach 1."""
    _, ratios = MD.pca_projection(C.features(spark, sf), "x", 64)
    cum = MD.cumulative_variance(ratios)
    rows = [(i + 1, bool(i == 0 or ratios[i] <= ratios[i - 1] + 1e-12),
             bool(abs(cum[i] - sum(ratios[:i + 1])) < 1e-9 and (i < 63 or abs(cum[i] - 1) < 1e-9))) for i in range(len(ratios))]
    return spark.createDataFrame(rows, "component bigint, decreasing boolean, adds_up boolean")


@register("feature_importance", "SELECT CAST(64 AS BIGINT) AS n, true AS sums_to_one, true AS ranked")
def q_feature_importance(spark, sf):
    """Importances of all features sum to 1 and are ranked."""
    tr, _ = _xy(spark, sf)
    f = MD.feature_importance(MD.fit(tr, "rf", "x", "y"), 64, spark)
    return f.agg(F.count(F.lit(1)).alias("n"), (F.abs(F.sum("importance") - 1) < 1e-9).alias("sums_to_one"),
                 (F.corr("rank", "importance") < 0).alias("ranked"))


@register("truncated_svd", _fx("SELECT count(*) AS n, CAST(63 AS INTEGER) AS k, true AS orthogonal, true AS norms FROM features", "features"))
def q_svd(spark, sf):
    """T9 on the 64-dim feature rows, k = min(1000, min(n, d) - 1): projected columns are
    orthogonal and their norms are the singular values."""
    f = C.features(spark, sf)
    k = min(1000, min(f.count(), 64) - 1)
    s, proj = MD.truncated_svd(f, "x", k)
    a, b = F.element_at("svd", 1), F.element_at("svd", 2)
    return proj.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("svd")).alias("k"),
                    (F.abs(F.sum(a * b)) < 1e-6 * float(s[0] * s[1])).alias("orthogonal"),
                    (F.abs(F.sqrt(F.sum(a * a)) - float(s[0])) < 1e-6 * float(s[0])).alias("norms"))
