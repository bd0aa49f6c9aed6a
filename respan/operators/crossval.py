"""Stratified folds and cross-validation on sufficient statistics.

Folds: quantile bins of the target (q = min(5, k) edges from exact percentiles,
duplicate edges dropped, right-closed bins), then inside each bin rows are ranked
by ``md5(key:seed)`` and dealt round-robin to folds, which balances every bin over
the folds like a shuffled stratified k-fold.  The per-bin rank is computed without
a one-task window: rows are ranked inside (bin, hash bucket) partitions and shifted
by the bucket's running offset, taken from a small (bins x 65 536) count table.

Cross-validation of closed-form models (mean predictor, one-feature ridge) needs no
model object: per-fold training parameters follow from per-fold sums (train = all -
fold), and every row is scored once per fold (k-fold expansion, k fixed), so train
and test errors of all folds come out of one grouped aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from respan.functions.hashing import hash_bucket, hash_hex
from respan.functions.quantiles import exact_percentiles
from respan.operators.metrics import _r2, scalar_row


def hash_rank(df: DataFrame, keys: Sequence[str], part: Sequence[str], seed: int = 42, digits: int = 4,
              out_col: str = "rank") -> DataFrame:
    """0-based rank of each row inside its ``part`` group in (md5(keys:seed), keys) order.

    The count table has at most (#groups x 16**digits) rows; ``part`` must be a small
    dimension (bins, folds, splits).
    """
    part = list(part)
    d = df.withColumn("_h", hash_hex(*keys, seed=seed)).withColumn("_b", hash_bucket(F.col("_h"), digits))
    counts = d.groupBy(*part, "_b").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*part).orderBy("_b")
    offsets = counts.withColumn("_off", F.sum("_c").over(w) - F.col("_c")).drop("_c")
    d = d.join(F.broadcast(offsets), part + ["_b"], "inner")
    wr = Window.partitionBy(*part, "_b").orderBy("_h", *keys)
    return d.withColumn(out_col, F.col("_off") + F.row_number().over(wr) - 1).drop("_h", "_b", "_off")


def quantile_bins(df: DataFrame, y: str, q: int) -> DataFrame:
    """pd.qcut(y, q, duplicates='drop', labels=False): bin = number of distinct interior
    edges strictly below y (right-closed, lowest value in bin 0)."""
    probs = [i / q for i in range(1, q)]
    edges = scalar_row(exact_percentiles(df, y, probs, names=[f"e{i}" for i in range(len(probs))]))
    uniq = sorted(set(v for v in edges.values() if v is not None))
    # distinct edges also drop an interior edge equal to the min or max of y
    mm = scalar_row(df.agg(F.min(y).alias("lo"), F.max(y).alias("hi")))
    uniq = [e for e in uniq if mm["lo"] < e < mm["hi"]] if mm else uniq
    binexpr = F.lit(0)
    for e in uniq:
        binexpr = binexpr + F.when(F.col(y) > F.lit(e), 1).otherwise(0)
    return df.withColumn("bin", binexpr.cast("int"))


def stratified_folds(df: DataFrame, key: str, y: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Add ``bin`` and ``fold`` (0..k-1) columns."""
    binned = quantile_bins(df, y, min(5, k))
    ranked = hash_rank(binned, [key], ["bin"], seed=seed, out_col="_r")
    return ranked.withColumn("fold", (F.col("_r") % k).cast("int")).drop("_r")


def _fold_params(folded: DataFrame, k: int, model: str, x: str | None, y: str, alpha: float) -> DataFrame:
    """Training parameters for each fold from (total - fold) sums; k rows."""
    sums = folded.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"), F.sum(y).alias("sy"),
        *([F.sum(x).alias("sx"), F.sum(F.col(x) * F.col(x)).alias("sxx"), F.sum(F.col(x) * F.col(y)).alias("sxy")]
          if x else []))
    # totals over the k fold rows by a window (k rows in one partition, bounded by k)
    everything = Window.partitionBy()
    p = sums
    for c in [c for c in sums.columns if c != "fold"]:
        p = p.withColumn(f"t_{c}", F.sum(c).over(everything))
    for c in [c for c in sums.columns if c != "fold"]:
        p = p.withColumn(f"tr_{c}", F.col(f"t_{c}") - F.col(c))
    if model == "mean":
        return p.select("fold", (F.col("tr_sy") / F.col("tr_n")).alias("b"), F.lit(0.0).alias("w"))
    if model == "ridge_1d":
        sxx_c = F.col("tr_sxx") - F.col("tr_sx") * F.col("tr_sx") / F.col("tr_n")
        sxy_c = F.col("tr_sxy") - F.col("tr_sx") * F.col("tr_sy") / F.col("tr_n")
        w = sxy_c / (sxx_c + F.lit(alpha))
        return p.select("fold", w.alias("w"), ((F.col("tr_sy") - w * F.col("tr_sx")) / F.col("tr_n")).alias("b"))
    raise ValueError(f"unknown closed-form model {model!r}")


def cross_validate(folded: DataFrame, k: int, y: str, x: str | None = None, model: str = "mean",
                   alpha: float = 1.0) -> DataFrame:
    """M9: per fold and role (train/test) mse, mae, r2 of a closed-form model.

    Returns fold scores in long form (fold, metric, train_score, test_score).
    """
    params = _fold_params(folded, k, model, x, y, alpha)
    rows = folded.select("fold", F.col(y).alias("_y"), (F.col(x) if x else F.lit(0.0)).alias("_x"))
    ex = rows.select(F.col("fold").alias("row_fold"), "_y", "_x",
                     F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("fold"))
    ex = ex.join(F.broadcast(params), "fold", "inner")  # k rows
    ex = ex.withColumn("role", F.when(F.col("row_fold") == F.col("fold"), "test").otherwise("train"))
    err = F.col("_y") - (F.col("w") * F.col("_x") + F.col("b"))
    sc = ex.groupBy("fold", "role").agg(
        F.avg(err * err).alias("mse"), F.avg(F.abs(err)).alias("mae"),
        _r2(F.sum(err * err), F.var_pop("_y") * F.count(F.lit(1))).alias("r2"))
    long = sc.selectExpr("fold", "role", "stack(3, 'mse', mse, 'mae', mae, 'r2', r2) AS (metric, score)")
    return (long.groupBy("fold", "metric")
            .agg(F.max(F.when(F.col("role") == "train", F.col("score"))).alias("train_score"),
                 F.max(F.when(F.col("role") == "test", F.col("score"))).alias("test_score")))
