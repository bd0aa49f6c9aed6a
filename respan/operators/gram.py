"""Ridge on whole feature vectors from grouped sums.

Rows carry a small integer group (fold, learning-curve interval).  One pass adds up, per
group, the products of z = (x, 1, y) with itself: (d + 2)^2 numbers, however many rows.
Tasks add in numpy, Spark sums by position.  Every fit on a union of groups (all folds but
one, a prefix of intervals) is then a d x d solve, so no row is copied for a fold.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = np.asarray(batch.column(1).flatten(), float).reshape(batch.num_rows, -1)
    return np.asarray(batch.column(0)), x, np.asarray(batch.column(2), float)


def _summed(df: DataFrame, group: str, x: str, y: str, add) -> dict[int, np.ndarray]:
    """Sums of the arrays that ``add(x, y)`` returns for the rows of each group."""
    schema = pa.schema([("g", pa.int32()), ("i", pa.int32()), ("v", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            g, xs, ys = _columns(batch)
            for k in np.unique(g):
                part = add(xs[g == k], ys[g == k]).ravel()
                total[int(k)] = total[int(k)] + part if int(k) in total else part
        for k, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), k, np.int32)),
                                              pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v)], schema=schema)

    rows = (df.select(F.col(group).cast("int"), F.col(x), F.col(y).cast("double")).na.drop()
            .mapInArrow(run, "g int, i int, v double").groupBy("g", "i").agg(F.sum("v").alias("v")).toArrow())
    out: dict[int, np.ndarray] = {}
    g, i, v = (rows.column(c).to_numpy() for c in ("g", "i", "v"))
    for k in np.unique(g):
        a = np.zeros(int(i[g == k].max()) + 1)
        a[i[g == k]] = v[g == k]
        out[int(k)] = a
    return out


def gram_sums(df: DataFrame, group: str, x: str, y: str) -> dict[int, np.ndarray]:
    """(d + 2, d + 2) sums of z z' with z = (x, 1, y), by group."""
    def add(xs, ys):
        z = np.concatenate([xs, np.ones((len(xs), 1)), ys[:, None]], axis=1)
        return z.T @ z

    return {k: v.reshape(int(np.sqrt(len(v))), -1) for k, v in _summed(df, group, x, y, add).items()}


def ridge(gram: np.ndarray, alpha: float) -> np.ndarray:
    """Coefficients and intercept (last) of min |y - Xw - b|^2 + alpha |w|^2."""
    n = gram[-2, -2]
    mean = gram[-2] / n
    centred = gram - n * np.outer(mean, mean)
    d = len(gram) - 2
    w = np.linalg.solve(centred[:d, :d] + alpha * np.eye(d), centred[:d, -1])
    return np.append(w, mean[-1] - w @ mean[:d])


def _centred(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Covariances of x, of x with y, means of x, and the mean of y."""
    n = gram[-2, -2]
    mean = gram[-2] / n
    cov = gram / n - np.outer(mean, mean)
    d = len(gram) - 2
    return cov[:d, :d], cov[:d, -1], mean[:d], mean[-1]


def lasso_path(gram: np.ndarray, alphas: Sequence[float], tol: float = 1e-13, max_sweeps: int = 20_000) -> np.ndarray:
    """Coefficients and intercept (last row) of min |y - Xw - b|^2 / 2n + alpha |w|_1, a column for
    each alpha: covariance coordinate descent, from the largest alpha on, each started where
    the one before ended.  A feature without variance has coefficient 0."""
    cov, cxy, mean, level = _centred(gram)
    d = len(cov)
    scale = np.diag(cov).copy()
    live = np.flatnonzero(scale > 1e-15 * max(1.0, float(scale.max(initial=0.0))))
    w, left = np.zeros(d), cxy.copy()  # left: covariance of each feature with the residual
    out = np.zeros((d + 1, len(alphas)))
    for column in sorted(range(len(alphas)), key=lambda i: -alphas[i]):
        alpha = alphas[column]
        for _ in range(max_sweeps):
            moved = 0.0
            for j in live:
                z = left[j] + scale[j] * w[j]
                new = np.sign(z) * max(abs(z) - alpha, 0.0) / scale[j]
                step = new - w[j]
                if step:
                    left -= cov[:, j] * step
                    w[j] = new
                    moved = max(moved, step * step * scale[j])
            if moved <= tol * tol * max(1.0, float(cxy @ cxy)):
                break
        out[:d, column], out[d, column] = w, level - w @ mean
    return out


def lasso_residual(gram: np.ndarray, model: np.ndarray, alpha: float) -> np.ndarray:
    """How far each feature is from the optimality condition of the lasso: the covariance with the
    residual is alpha times the sign of a coefficient, and within alpha where that is 0."""
    cov, cxy, _, _ = _centred(gram)
    w = model[:-1]
    g = cxy - cov @ w
    return np.where(w != 0, np.abs(g - alpha * np.sign(w)), np.maximum(np.abs(g) - alpha, 0.0))


def error_sums(df: DataFrame, group: str, x: str, y: str, models: np.ndarray) -> dict[int, np.ndarray]:
    """For each group and model (columns of ``models``): n, sum e^2, sum |e|, sum y, sum y^2."""
    def add(xs, ys):
        e = ys[:, None] - (xs @ models[:-1] + models[-1])
        one = np.ones(e.shape[1])
        return np.stack([len(ys) * one, (e * e).sum(axis=0), np.abs(e).sum(axis=0), ys.sum() * one, (ys * ys).sum() * one])

    return {k: v.reshape(5, -1) for k, v in _summed(df, group, x, y, add).items()}


def metrics(sums: np.ndarray) -> dict[str, float]:
    """mse, mae and r2 of (n, sum e^2, sum |e|, sum y, sum y^2)."""
    n, sse, sae, sy, syy = (float(v) for v in sums)
    sst = syy - sy * sy / n
    r2 = (1.0 if sse == 0 else 0.0) if sst <= 1e-12 * max(1.0, syy) else 1.0 - sse / sst
    return {"mse": sse / n, "mae": sae / n, "r2": r2}


def cross_validate_path(folded: DataFrame, x: str, y: str, alphas: Sequence[float], kind: str = "lasso", fold: str = "fold") -> DataFrame:
    """M9: (fold, alpha, metric, train_score, test_score, optimality) of lasso or ridge on all features:
    two passes over the rows for all folds and alphas, the fits come from the Gram matrices.
    ``optimality`` is the largest residual of the fit's optimality condition."""
    gram = gram_sums(folded, fold, x, y)
    ids = sorted(gram)
    total = sum(gram.values())
    fits, off = [], {}
    for k in ids:
        rest = total - gram[k]
        if kind == "lasso":
            fits.append(lasso_path(rest, alphas))
            far = [lasso_residual(rest, fits[-1][:, i], a).max(initial=0.0) for i, a in enumerate(alphas)]
        elif kind == "ridge":
            fits.append(np.stack([ridge(rest, a) for a in alphas], axis=1))
            cov, cxy, _, _ = _centred(rest)
            far = [np.abs(cxy - cov @ fits[-1][:-1, i] - a / rest[-2, -2] * fits[-1][:-1, i]).max(initial=0.0) for i, a in enumerate(alphas)]
        else:
            raise ValueError(f"unknown model {kind!r}")
        off[k] = far
    errors = error_sums(folded, fold, x, y, np.concatenate(fits, axis=1))
    rows = []
    for j, k in enumerate(ids):
        for i, a in enumerate(alphas):
            column = j * len(alphas) + i
            test = metrics(errors[k][:, column])
            train = metrics(sum(errors[o][:, column] for o in ids if o != k))
            rows += [(k, float(a), m, train[m], test[m], float(off[k][i])) for m in ("mse", "mae", "r2")]
    return folded.sparkSession.createDataFrame(
        rows, "fold int, alpha double, metric string, train_score double, test_score double, optimality double")


def cross_validate_ridge(folded: DataFrame, x: str, y: str, alpha: float = 1.0, fold: str = "fold") -> DataFrame:
    """M9: (fold, metric, train_score, test_score) of ridge on all features."""
    return cross_validate_path(folded, x, y, [alpha], "ridge", fold).select("fold", "metric", "train_score", "test_score")


def learning_curve_ridge(train: DataFrame, others: dict[str, DataFrame], x: str, y: str, rank: str,
                         fractions: Sequence[float], alpha: float = 1.0) -> DataFrame:
    """Ridge on all features fitted on nested prefixes of ``train`` (rows by ``rank``, from
    0): (fraction, n, split, metric, value).  Each row belongs to one interval between
    prefix ends; interval sums are added up, so no row is copied for a prefix."""
    n = train.count()
    ends = [min(n, max(10, int(np.floor(f * n)))) for f in fractions]
    interval = F.lit(len(ends))
    for i in reversed(range(len(ends))):
        interval = F.when(F.col(rank) < ends[i], F.lit(i)).otherwise(interval)
    marked = train.withColumn("_interval", interval).where(F.col("_interval") < len(ends))
    gram = gram_sums(marked, "_interval", x, y)
    prefix, fits = 0, []
    for i in range(len(ends)):
        prefix = prefix + gram.get(i, 0)
        fits.append(ridge(prefix, alpha))
    models = np.stack(fits, axis=1)
    per = error_sums(marked, "_interval", x, y, models)
    rows = []
    for j, f in enumerate(fractions):
        found = {"train": metrics(sum(per[i][:, j] for i in range(j + 1) if i in per))}
        rows += [(float(f), ends[j], "train", m, v) for m, v in found["train"].items()]
    for name, df in others.items():
        sums = error_sums(df.withColumn("_interval", F.lit(0)), "_interval", x, y, models).get(0)
        if sums is not None:
            rows += [(float(f), ends[j], name, m, v) for j, f in enumerate(fractions) for m, v in metrics(sums[:, j]).items()]
    return train.sparkSession.createDataFrame(rows, "fraction double, n int, split string, metric string, value double")
