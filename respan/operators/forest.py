"""Fitted forests as a node table (M4, M8).

A forest is read back from its saved form as rows (tree, node, feature, threshold, left, right,
count, mean): at most trees x 2^(depth + 1) of them, whatever the number of training rows.  A node
with fewer bagged rows than ``min_samples_split`` becomes a leaf with its mean.  Trees grow greedily from the
root, so a tree grown under that rule is the full tree without what lies below such nodes:
collapsing them afterwards gives the same splits.

Rows are scored by walking all trees level by level in a vectorised function.  The members'
predictions are the draws of the uncertainty of a row.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from respan.session import scratch_path

COLUMNS = ["tree", "node", "feature", "threshold", "left", "right", "count", "mean", "gain"]


def node_table(spark: SparkSession, model) -> pd.DataFrame:
    """The nodes of a fitted MLlib forest (leaves have feature -1)."""
    path = scratch_path(spark, f"forest-{uuid.uuid4().hex}")
    model.save(path)
    n = F.col("nodeData")
    rows = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), n.id.alias("node"), n.split.featureIndex.alias("feature"),
        F.coalesce(F.get(n.split.leftCategoriesOrThreshold, F.lit(0)), F.lit(0.0)).alias("threshold"), n.leftChild.alias("left"),
        n.rightChild.alias("right"), n.rawCount.alias("count"), n.prediction.alias("mean"), n.gain.alias("gain"))
    return rows.toPandas().sort_values(["tree", "node"]).reset_index(drop=True)


class ForestModel:
    """A forest with nodes below ``min_samples_split`` bagged rows collapsed."""

    def __init__(self, nodes: pd.DataFrame, n_features: int, depth: int, min_samples_split: int = 2):
        nodes = nodes.copy()
        nodes.loc[(nodes["count"] < min_samples_split) & (nodes["feature"] >= 0), "feature"] = -1
        self.nodes, self.n_features, self.depth = nodes, n_features, depth
        self.n_trees = int(nodes["tree"].nunique())
        # one array a column over all trees; children as places in it
        first = nodes.groupby("tree", sort=True).size().cumsum().shift(fill_value=0)
        base = nodes["tree"].map(first).to_numpy()
        self.roots = first.to_numpy()
        leaf = nodes["feature"].to_numpy() < 0
        here = np.arange(len(nodes))
        self.feature = np.where(leaf, 0, nodes["feature"].to_numpy())
        self.threshold = np.where(leaf, np.inf, nodes["threshold"].to_numpy())
        self.left = np.where(leaf, here, base + nodes["left"].to_numpy())
        self.right = np.where(leaf, here, base + nodes["right"].to_numpy())
        self.mean = nodes["mean"].to_numpy(dtype=float)

    def predict(self, xs: np.ndarray) -> np.ndarray:
        """(rows, trees) predictions."""
        at = np.tile(self.roots, (len(xs), 1))
        row = np.arange(len(xs))[:, None]
        for _ in range(self.depth):
            at = np.where(xs[row, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.mean[at]

    def _scored(self, df: DataFrame, x: str, out: str, ddl: str, of) -> DataFrame:
        @F.pandas_udf(ddl)
        def run(v: pd.Series) -> pd.DataFrame:
            draws = self.predict(np.vstack(v.to_numpy()).astype(float)) if len(v) else np.zeros((0, self.n_trees))
            return of(draws)

        return df.withColumn(out, run(F.col(x)))

    def transform(self, df: DataFrame, x: str, out: str = "yhat") -> DataFrame:
        scored = self._scored(df, x, "_s", "p double", lambda d: pd.DataFrame({"p": d.mean(axis=1)}))
        return scored.withColumn(out, F.col("_s.p")).drop("_s")

    def uncertainty(self, df: DataFrame, x: str, keep: list[str]) -> DataFrame:
        """M8: mean and std (ddof 1) of the members' predictions of every row."""
        def of(d: np.ndarray) -> pd.DataFrame:
            std = d.std(axis=1, ddof=1) if self.n_trees > 1 else np.full(len(d), np.nan)
            return pd.DataFrame({"m": d.mean(axis=1), "s": std})

        scored = self._scored(df.select(*keep, x), x, "_s", "m double, s double", of)
        return scored.select(*keep, F.col("_s.m").alias("mean_pred"), F.col("_s.s").alias("std_pred"),
                             F.lit(self.n_trees).cast("long").alias("n_draws"))

    @property
    def featureImportances(self) -> DenseVector:
        """Gain times rows by feature over the splits that are left, each tree and then the sum scaled to 1."""
        total = np.zeros(self.n_features)
        reached = self._reached()
        for _, g in self.nodes[reached].groupby("tree"):
            s = g[g["feature"] >= 0]
            mine = np.bincount(s["feature"], weights=s["gain"] * s["count"], minlength=self.n_features)
            total += mine / mine.sum() if mine.sum() else mine
        return DenseVector(total / total.sum() if total.sum() else total)

    def _reached(self) -> np.ndarray:
        seen = np.zeros(len(self.nodes), bool)
        at = self.roots
        for _ in range(self.depth + 1):
            seen[at] = True
            at = np.unique(np.concatenate([self.left[at], self.right[at]]))
        return seen


def fit_forest(train: DataFrame, estimator, min_samples_split: int = 2) -> ForestModel:
    """Fit an MLlib forest on ``train`` and take its node table."""
    model = estimator.fit(train)
    return ForestModel(node_table(train.sparkSession, model), model.numFeatures, estimator.getMaxDepth(), min_samples_split)
