"""M5: epsilon-insensitive support vector regression.

Objective (the summed loss of the reference solver)::

    0.5 ||w||^2 + C * sum_i max(0, |y_i - w.phi(x_i) - b| - epsilon)

``phi`` is the identity (linear), random Fourier features (rbf) or a polynomial expansion
(poly).  The loss's corners are smoothed over a width that shrinks in rounds; each round is
a damped Newton iteration to tolerance.  One iteration is one pass: tasks add up loss,
gradient and curvature of their rows in numpy, Spark sums them by position, and the driver
receives one row each of the (d + 1)(d + 2) numbers, however many partitions there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values (reference defaults)
DEFAULTS = {"C": 1.0, "epsilon": 0.1, "kernel": "rbf", "gamma": "scale", "degree": 3}
FOURIER_FEATURES = 128
TOLERANCE = 1e-5
MAX_PASSES = 200


class FeatureMap:
    """phi for a kernel; plain data, so it travels to the tasks."""

    def __init__(self, kernel: str, d: int, gamma: float, degree: int, seed: int = 42):
        self.kernel, self.d = kernel, d
        if kernel == "rbf":
            rng = np.random.default_rng(seed)
            self.omega = rng.normal(0.0, np.sqrt(2.0 * gamma), (d, FOURIER_FEATURES))
            self.phase = rng.uniform(0.0, 2.0 * np.pi, FOURIER_FEATURES)
        elif kernel == "poly":
            self.terms = [t for k in range(1, degree + 1) for t in combinations_with_replacement(range(d), k)]
            self.scale = np.sqrt(gamma)
        elif kernel != "linear":
            raise ValueError(f"unknown kernel {kernel!r} (linear, rbf, poly)")

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.kernel == "rbf":
            return np.sqrt(2.0 / FOURIER_FEATURES) * np.cos(x @ self.omega + self.phase)
        if self.kernel == "poly":
            return np.stack([np.prod(self.scale * x[:, list(t)], axis=1) for t in self.terms], axis=1)
        return x


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(len(column), -1)


class SVRModel:
    """w, b and phi; ``transform`` adds the prediction to a DataFrame."""

    def __init__(self, phi: FeatureMap, w: np.ndarray, b: float, passes: int):
        self.phi, self.w, self.b, self.passes = phi, w, b, passes

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.phi(x) @ self.w + self.b

    def transform(self, df: DataFrame, x: str, out: str = "yhat") -> DataFrame:
        model = self

        @F.pandas_udf("double")
        def run(col):
            import pandas as pd

            return pd.Series(model.predict(np.vstack(col.to_numpy())) if len(col) else np.empty(0))

        return df.withColumn(out, run(F.col(x)))


def _scale_gamma(train: DataFrame, x: str, d: int) -> float:
    """1 / (d * variance of all entries)."""
    v = train.select(F.explode(x).alias("v")).agg(F.var_pop("v").alias("v")).first()["v"]
    return 1.0 / (d * v) if v else 1.0


def _sums(data: DataFrame, phi: FeatureMap, theta: np.ndarray, C: float, epsilon: float, width: float) -> tuple:
    """Loss, gradient and curvature of the smoothed loss at ``theta`` = (w, b)."""
    schema = pa.schema([("i", pa.int32()), ("v", pa.float64())])
    m = len(theta)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + m + m * m)
        for batch in batches:
            if not batch.num_rows:
                continue
            z = phi(_matrix(batch.column(0)))
            z = np.concatenate([z, np.ones((len(z), 1))], axis=1)
            r = z @ theta - np.asarray(batch.column(1), float)
            t = np.abs(r) - epsilon
            inside = (t > 0) & (t < width)
            loss = np.where(t <= 0, 0.0, np.where(inside, t * t / (2 * width), t - width / 2))
            slope = np.where(t <= 0, 0.0, np.where(inside, t / width, 1.0)) * np.sign(r)
            total[0] += loss.sum()
            total[1:m + 1] += z.T @ slope
            zi = z[inside]
            total[m + 1:] += (zi.T @ zi / width).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(C * total)], schema=schema)

    rows = data.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    total = np.zeros(1 + m + m * m)
    total[rows.column("i").to_numpy()] = rows.column("v").to_numpy()
    reg = np.append(np.ones(m - 1), 0.0)
    return (total[0] + 0.5 * float((reg * theta * theta).sum()), total[1:m + 1] + reg * theta,
            total[m + 1:].reshape(m, m) + np.diag(reg))


def fit_svr(train: DataFrame, x: str, y: str, C: float = 1.0, epsilon: float = 0.1, kernel: str = "rbf",
            gamma: str | float = "scale", degree: int = 3, tol: float = TOLERANCE) -> SVRModel:
    """Fit to tolerance; rows with a null are left out, no row at all is an error."""
    data = train.select(x, F.col(y).cast("double").alias(y)).where(F.col(x).isNotNull() & F.col(y).isNotNull())
    first = data.select(F.size(x).alias("d")).first()
    if first is None:
        raise ValueError("no training rows")
    d = first["d"]
    if kernel != "linear" and gamma == "scale":
        gamma = _scale_gamma(data, x, d)
    phi = FeatureMap(kernel, d, 1.0 / d if gamma == "auto" else gamma if gamma != "scale" else 1.0, degree)
    m = phi(np.zeros((1, d))).shape[1] + 1
    middle, spread = data.agg(F.percentile_approx(y, 0.5).alias("m"), F.stddev_pop(y).alias("s")).first()
    theta = np.zeros(m)
    theta[-1] = middle
    width, passes = max(spread or 0.0, 1e-3), 0
    least = max(1e-2 * (spread or 0.0), 1e-6)
    while True:
        loss, grad, curve = _sums(data, phi, theta, C, epsilon, width)
        passes += 1
        while passes < MAX_PASSES:
            move = np.linalg.solve(curve + 1e-8 * np.eye(m) * max(1.0, float(np.trace(curve)) / m), -grad)
            step, gain = 1.0, float(grad @ move)
            if -gain <= tol * max(1.0, abs(loss)):
                break
            while True:  # halve until the loss falls enough
                new = _sums(data, phi, theta + step * move, C, epsilon, width)
                passes += 1
                if new[0] <= loss + 1e-4 * step * gain or step < 1e-6:
                    break
                step /= 2
            theta = theta + step * move
            small = loss - new[0] <= tol * max(1.0, abs(loss))
            loss, grad, curve = new
            if small:
                break
        if width <= least or passes >= MAX_PASSES:
            return SVRModel(phi, theta[:-1], float(theta[-1]), passes)
        width = max(width / 10, least)
