"""Target scaling, model fitting/scoring and search.

Fitting uses MLlib where it has the estimator (ridge/lasso via LinearRegression,
random forest, PCA, SVD); closed-form one-feature ridge and the mean predictor are
aggregates over sufficient statistics, so learning curves and fold scores need no
model objects at all.  ``predict_with`` runs an arbitrary Python model batch-wise
inside ``mapInPandas`` (loaded once per task); the support vector regression is in svr.py.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from respan.functions.hashing import uniform
from respan.operators import forest, svr
from respan.operators.crossval import hash_rank
from respan.operators.metrics import regression_metrics, scalar_row

# Fixed values (reference defaults)
RF_DEFAULTS = {"n_estimators": 10, "max_depth": 5, "min_samples_split": 2, "min_samples_leaf": 1}
RIDGE_ALPHA = 1.0
LASSO_ALPHA = 1.0
SVR_DEFAULTS = svr.DEFAULTS
LEARNING_CURVE_FRACTIONS = [0.1, 0.2, 0.4, 0.6, 0.8, 1.0]
N_TRIALS = 30
RF_SPACE = {"n_estimators": [5, 10, 20], "max_depth": [3, 5, 7], "min_samples_split": (2, 10),
            "min_samples_leaf": (1, 5)}
ALPHA_RANGE = (1e-5, 10.0)
UNCERTAINTY_DRAWS = 10


# ---------------------------------------------------------------- M1 target scaling

def target_scaler(train: DataFrame, y: str) -> dict:
    """Mean and population std of the training target; a constant target scales by 1."""
    s = scalar_row(train.agg(F.avg(y).alias("mean"), F.stddev_pop(y).alias("std")))
    if not s.get("std"):
        s["std"] = 1.0
    return s


def scale_targets(df: DataFrame, y: str, scaler: dict, out: str = "y_scaled") -> DataFrame:
    return df.withColumn(out, (F.col(y) - F.lit(scaler["mean"])) / F.lit(scaler["std"]))


def unscale(df: DataFrame, col: str, scaler: dict, out: str | None = None) -> DataFrame:
    return df.withColumn(out or col, F.col(col) * F.lit(scaler["std"]) + F.lit(scaler["mean"]))


# ---------------------------------------------------------------- closed-form one-feature ridge

def ridge_1d(train: DataFrame, x: str, y: str, alpha: float = RIDGE_ALPHA) -> DataFrame:
    """Ridge with intercept on one feature from five sums: w = Sxy_c / (Sxx_c + alpha)."""
    s = train.agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"),
                  F.sum(F.col(x) * F.col(x)).alias("sxx"), F.sum(F.col(x) * F.col(y)).alias("sxy"))
    sxx = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")
    sxy = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    w = sxy / (sxx + F.lit(alpha))
    return s.select(w.alias("w"), ((F.col("sy") - w * F.col("sx")) / F.col("n")).alias("b"), "n")


def learning_curve_samples(train: DataFrame, key: str, fractions: Sequence[float] = LEARNING_CURVE_FRACTIONS,
                           seed: int = 42) -> DataFrame:
    """For each fraction f the first n_f = max(10, floor(f N)) training rows in hash
    order (rows are expanded once per fraction, a fixed small factor)."""
    n = train.count()
    ranked = _global_hash_rank(train, key, seed)
    sizes = F.array(*[F.struct(F.lit(float(f)).alias("fraction"), F.lit(max(10, int(np.floor(f * n)))).alias("n_f"))
                      for f in fractions])
    ex = ranked.select("*", F.explode(sizes).alias("_fs"))
    ex = ex.select("*", F.col("_fs.fraction").alias("fraction"), F.col("_fs.n_f").alias("n_f")).drop("_fs")
    return ex.where(F.col("_rank") < F.col("n_f"))


def _global_hash_rank(df: DataFrame, key: str, seed: int) -> DataFrame:
    d = df.withColumn("_part", F.lit(0))
    return hash_rank(d, [key], ["_part"], seed=seed, out_col="_rank").drop("_part")


def learning_curve(train: DataFrame, val: DataFrame, key: str, x: str, y: str, alpha: float = RIDGE_ALPHA,
                   fractions: Sequence[float] = LEARNING_CURVE_FRACTIONS) -> DataFrame:
    """One-feature ridge fitted on each prefix, train and validation MSE per fraction,
    all prefixes in one grouped aggregate."""
    pref = learning_curve_samples(train, key, fractions)
    s = pref.groupBy("fraction", "n_f").agg(
        F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"),
        F.sum(F.col(x) * F.col(x)).alias("sxx"), F.sum(F.col(x) * F.col(y)).alias("sxy"))
    sxx = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")
    sxy = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    params = s.select("fraction", "n", (sxy / (sxx + F.lit(alpha))).alias("w"), "sx", "sy")
    params = params.select("fraction", "n", "w", ((F.col("sy") - F.col("w") * F.col("sx")) / F.col("n")).alias("b"))
    err = F.col(y) - (F.col("w") * F.col(x) + F.col("b"))
    tr = pref.join(F.broadcast(params.drop("n")), "fraction").groupBy("fraction").agg(F.avg(err * err).alias("train_mse"))
    vx = val.select(x, y, F.explode(F.array(*[F.lit(float(f)) for f in fractions])).alias("fraction"))
    va = vx.join(F.broadcast(params.drop("n")), "fraction").groupBy("fraction").agg(F.avg(err * err).alias("val_mse"))
    return params.select("fraction", "n").join(tr, "fraction").join(va, "fraction")


# ---------------------------------------------------------------- MLlib estimators

def _vec(df: DataFrame, x: str) -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(x)))


def ridge_estimator(train: DataFrame, y: str, alpha: float = RIDGE_ALPHA) -> LinearRegression:
    """M2: sklearn Ridge(alpha) as MLlib normal-equation least squares.  MLlib scales the
    penalty by the label's std internally, so regParam = alpha * std_pop(y) / n."""
    s = scalar_row(train.agg(F.stddev_pop(y).alias("sd"), F.count(F.lit(1)).alias("n")))
    reg = alpha * (s["sd"] or 1.0) / s["n"]
    return LinearRegression(featuresCol="features", labelCol=y, solver="normal", elasticNetParam=0.0,
                            standardization=False, regParam=reg)


def lasso_estimator(alpha: float, y: str) -> LinearRegression:
    """M3: sklearn Lasso(alpha) objective (1/2n)||y - Xw - b||^2 + alpha ||w||_1."""
    return LinearRegression(featuresCol="features", labelCol=y, elasticNetParam=1.0, regParam=alpha,
                            standardization=False, maxIter=500, tol=1e-9)


def rf_estimator(y: str, n_estimators: int = 10, max_depth: int = 5, min_samples_leaf: int = 1,
                 seed: int = 42) -> RandomForestRegressor:
    """M4: random forest with the reference defaults (binned splits: equal in kind).
    ``min_samples_split`` has no counterpart here; see :mod:`respan.operators.forest`."""
    return RandomForestRegressor(featuresCol="features", labelCol=y, numTrees=n_estimators, maxDepth=max_depth,
                                 minInstancesPerNode=min_samples_leaf, seed=seed)


def fit(train: DataFrame, kind: str, x: str, y: str, params: dict | None = None):
    """M6: fit dispatch by model name; unknown names are an error."""
    params = params or {}
    t = _vec(train, x)
    if kind == "ridge":
        return ridge_estimator(t, y, params.get("alpha", RIDGE_ALPHA)).fit(t)
    if kind == "lasso":
        return lasso_estimator(params.get("alpha", LASSO_ALPHA), y).fit(t)
    if kind == "rf":
        rf = rf_estimator(y, params.get("n_estimators", 10), params.get("max_depth", 5), params.get("min_samples_leaf", 1))
        return forest.fit_forest(t, rf, params.get("min_samples_split", 2))
    if kind in ("svm", "svr"):
        return svr.fit_svr(train, x, y, **{**SVR_DEFAULTS, **params})
    raise ValueError(f"Unknown model type: {kind}")


def score(model, df: DataFrame, x: str, out: str = "yhat") -> DataFrame:
    """M7: batch scoring (MLlib transform, the SVR model or a forest's node table)."""
    if isinstance(model, (svr.SVRModel, forest.ForestModel)):
        return model.transform(df, x, out)
    return model.transform(_vec(df, x)).withColumnRenamed("prediction", out).drop("features")


def predict_with(df: DataFrame, make_model: Callable[[], Callable[[np.ndarray], np.ndarray]], x: str,
                 out: str = "yhat", keep: Sequence[str] = ()) -> DataFrame:
    """M7 / UDF surface: any object with ``predict(X)`` applied batch-wise (Arrow
    batches bounded by spark.sql.execution.arrow.maxRecordsPerBatch)."""
    keep = list(keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = make_model()
        for b in batches:
            xs = np.vstack(b[x].to_numpy()) if len(b) else np.zeros((0, 0))
            res = b[keep].copy()
            res[out] = np.asarray(predict(xs), dtype=float) if len(b) else []
            yield res

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields]
                       + [f"`{out}` double"])
    return df.select(*keep, x).mapInPandas(run, schema)


# ---------------------------------------------------------------- M8 uncertainty

def predictive_uncertainty(draws: DataFrame, keys: Sequence[str] = ("row_id",)) -> DataFrame:
    """M8: mean and std (ddof 1) over repeated stochastic predictions per row; a fitted forest
    gives them without a table of draws (``ForestModel.uncertainty``)."""
    return draws.groupBy(*keys).agg(F.avg("pred").alias("mean_pred"), F.stddev_samp("pred").alias("std_pred"),
                                  F.count(F.lit(1)).alias("n_draws"))


# ---------------------------------------------------------------- M11 search

def search_space(trials: DataFrame, seed: int = 42) -> DataFrame:
    """A hash-seeded random configuration per trial (study, number): forest grid
    values, split/leaf integers and log-uniform alpha."""
    def pick(values, salt):
        u = uniform(F.col("study"), F.col("number"), F.lit(salt), seed=seed)
        return F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(u * len(values)) + 1).cast("int"))

    def integer(lo, hi, salt):
        u = uniform(F.col("study"), F.col("number"), F.lit(salt), seed=seed)
        return (F.lit(lo) + F.floor(u * (hi - lo + 1))).cast("int")

    ua = uniform(F.col("study"), F.col("number"), F.lit("alpha"), seed=seed)
    lo, hi = np.log(ALPHA_RANGE[0]), np.log(ALPHA_RANGE[1])
    return trials.select("study", "number").distinct().select(
        "study", "number", pick(RF_SPACE["n_estimators"], "n_estimators").alias("n_estimators"),
        pick(RF_SPACE["max_depth"], "max_depth").alias("max_depth"),
        integer(*RF_SPACE["min_samples_split"], "min_samples_split").alias("min_samples_split"),
        integer(*RF_SPACE["min_samples_leaf"], "min_samples_leaf").alias("min_samples_leaf"),
        F.exp(F.lit(lo) + ua * F.lit(hi - lo)).alias("alpha"))


OBJECTIVES = ("val_mse", "val_mae", "val_r2")
SPACE_PARAMS = {"rf": ("n_estimators", "max_depth", "min_samples_split", "min_samples_leaf"), "ridge": ("alpha",),
                "lasso": ("alpha",)}


def validation_metrics(kind: str, params: dict, train: DataFrame, val: DataFrame, x: str, y: str) -> dict:
    """Fit one configuration and score it on validation: the three objectives."""
    m = regression_metrics(score(fit(train, kind, x, y, params), val, x), [], y=y, relative=False).first()
    return {"val_mse": float(m["mse"]), "val_mae": float(m["mae"]), "val_r2": float(m["r2"])}


def hyperparameter_search(train: DataFrame, val: DataFrame, x: str, y: str, configs: Sequence[dict],
                          kinds: Sequence[str] = ("rf", "ridge", "lasso"), metric: str = "val_mse",
                          objective: Callable[[str, dict, DataFrame, DataFrame, str, str], dict] = validation_metrics,
                          parallelism: int = 4) -> DataFrame:
    """Every configuration (rows of :func:`search_space`) for every kind, with that
    kind's parameters only; driver threads submit concurrent jobs.  ``objective`` is any
    callable with the arguments of :func:`validation_metrics`.  One row per (kind, trial)
    and its value to be minimised (r2 is negated, a failed trial is +infinity); equal
    configurations of a kind are fitted once.  Best first."""
    if metric not in OBJECTIVES:
        raise ValueError(f"unknown objective metric {metric!r}")

    def run(job):
        kind, params = job
        try:
            found = objective(kind, dict(params), train, val, x, y)
        except Exception as ex:  # a failed trial does not end the study
            return job, {m: float("inf") for m in OBJECTIVES}, repr(ex)
        return job, found, None

    wanted = [(k, tuple((p, c[p]) for p in SPACE_PARAMS[k])) for k in kinds for c in configs]
    with ThreadPoolExecutor(max_workers=parallelism) as ex:
        done = {job: (found, error) for job, found, error in ex.map(run, list(dict.fromkeys(wanted)))}
    rows = []
    for n, job in enumerate(wanted):
        found, error = done[job]
        value = -found[metric] if metric == "val_r2" and error is None else found[metric]
        rows.append((job[0], n % len(configs), str(dict(job[1])), *[found[m] for m in OBJECTIVES], value, error))
    schema = "kind string, trial int, params string, val_mse double, val_mae double, val_r2 double, objective double, error string"
    return train.sparkSession.createDataFrame(rows, schema).orderBy("objective", "kind", "trial")


# ---------------------------------------------------------------- T9, T20, T21

def pca_projection(df: DataFrame, x: str, k: int = 2, keep: Sequence[str] = ("row_id",)):
    """PCA projection to k dims and explained-variance ratios (MLlib)."""
    v = _vec(df, x)
    model = PCA(k=k, inputCol="features", outputCol="pc").fit(v)
    proj = model.transform(v).select(*keep, vector_to_array("pc").alias("pc"))
    ratios = [float(r) for r in model.explainedVariance.toArray()]
    return proj, ratios


def cumulative_variance(ratios: Sequence[float]) -> list[float]:
    """Running sum of explained-variance ratios."""
    return list(np.cumsum(ratios))


def truncated_svd(df: DataFrame, x: str, k: int):
    """Uncentred truncated SVD of the feature rows (RowMatrix.computeSVD); returns
    singular values and the projection U*S as (row, array) pairs via V broadcast."""
    from pyspark.mllib.linalg.distributed import RowMatrix
    from pyspark.mllib.linalg import Vectors as OldVectors

    rows = df.select(x).rdd.map(lambda r: OldVectors.dense(r[0]))
    svd = RowMatrix(rows).computeSVD(k, computeU=False)
    V = svd.V.toArray()
    s = svd.s.toArray()
    vb = [[float(c) for c in row] for row in V.T]  # k x d, bounded by k * d
    proj = F.array(*[F.aggregate(F.zip_with(F.col(x), F.array(*[F.lit(c) for c in comp]), lambda a, c: a * c),
                                 F.lit(0.0), lambda acc, v: acc + v) for comp in vb])
    return s, df.withColumn("svd", proj)


def feature_importance(model, top_k: int = 50, spark=None) -> DataFrame:
    """Forest feature importances as rows, top k."""
    imp = model.featureImportances.toArray()
    pdf = pd.DataFrame({"feature": np.arange(len(imp), dtype=np.int64), "importance": imp})
    pdf = pdf.sort_values(["importance", "feature"], ascending=[False, True]).head(top_k)
    pdf["rank"] = np.arange(1, len(pdf) + 1, dtype=np.int64)
    return spark.createDataFrame(pdf)


def assemble(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=out).transform(df)


def window_first(df: DataFrame, part, order) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*part).orderBy(*order))).where("_rn = 1")
