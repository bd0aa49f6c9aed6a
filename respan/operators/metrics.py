"""Regression evaluation on scored tables.

All operators take a *scored* DataFrame with an actual column ``y`` and a
prediction column ``yhat`` (names configurable) plus any grouping columns
(split, model, target, ...).  Every metric is one grouped aggregate over sums, so
the shuffle carries one partial row per group and map task regardless of the
number of scored rows.  Percentiles use :mod:`respan.functions.quantiles`.

Conventions kept from the reference:

* R^2 = 1 - SSE/SST; when SST = 0 it is 1.0 for a perfect fit and 0.0 otherwise.
* MAPE only when mean(y) != 0, over rows with |y| > 1e-6, x100, capped at 1000;
  absent when no row qualifies.  RRMSE = RMSE / mean(y) * 100 when mean(y) != 0.
* Standard deviations in evaluation are population (ddof 0).
* Residuals: ``actual - predicted`` in the statistics tables (``err``).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from respan.functions.hashing import with_stream_seed, with_stream_uniform
from respan.functions.quantiles import exact_percentiles

# Fixed values (must equal the reference's constants)
MAPE_MIN_ABS_Y = 1e-6
MAPE_CAP = 1000.0
TARGET_NAMES = ["avg", "min", "max"]
ERROR_PERCENTILES = [1, 5, 25, 75, 95, 99]
WITHIN_PCTS = [1, 5, 10, 20]
COMBINED_LOSS_WEIGHTS = (0.8, 0.2)


def _poisson1_cdf(resolution: float = 2.0 ** -33) -> list[float]:
    """P(X <= k) of a Poisson(1) variable, until the rest is below the resolution of the
    32-bit uniforms (so no weight is cut off)."""
    out, term, total, k = [], math.exp(-1.0), 0.0, 0
    while 1.0 - total > resolution:
        total += term
        out.append(total)
        k += 1
        term /= k
    return out


POISSON1_CDF = _poisson1_cdf()


def _r2(sse: Column, sst: Column) -> Column:
    return (F.when(sst == 0, F.when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
            .otherwise(F.lit(1.0) - sse / sst))


def regression_metrics(df: DataFrame, groups: Sequence[str] = (), y: str = "y", yhat: str = "yhat",
                       relative: bool = True, mape_cap: float | None = MAPE_CAP) -> DataFrame:
    """A3 + A4: n, mse, mae, rmse, r2 (+ mape, rrmse) per group; ``mape_cap`` None reports
    the mean as it is."""
    err = F.col(y) - F.col(yhat)
    aggs = [
        F.count(F.lit(1)).alias("n"),
        F.avg(err * err).alias("mse"),
        F.avg(F.abs(err)).alias("mae"),
        F.sum(err * err).alias("_sse"),
        (F.var_pop(y) * F.count(F.lit(1))).alias("_sst"),
    ]
    if relative:
        mask = F.abs(F.col(y)) > MAPE_MIN_ABS_Y
        aggs += [
            F.avg(y).alias("_mean_y"),
            F.avg(F.when(mask, F.abs(err / F.col(y)))).alias("_ape"),
        ]
    out = df.groupBy(*groups).agg(*aggs)
    out = out.withColumn("rmse", F.sqrt("mse")).withColumn("r2", _r2(F.col("_sse"), F.col("_sst")))
    if relative:
        nonzero = F.col("_mean_y") != 0
        # least() skips nulls, so an empty mask must be tested explicitly (MAPE absent)
        has_mask = F.col("_ape").isNotNull()
        mape = F.col("_ape") * 100.0 if mape_cap is None else F.least(F.col("_ape") * 100.0, F.lit(mape_cap))
        out = (out.withColumn("mape", F.when(nonzero & has_mask, mape))
               .withColumn("rrmse", F.when(nonzero, F.col("rmse") / F.col("_mean_y") * 100.0)))
        out = out.drop("_mean_y", "_ape")
    return out.drop("_sse", "_sst")


def stack_targets(df: DataFrame, keep: Sequence[str],
                  targets: Sequence[tuple[str, str, str]] = (("avg", "y", "yhat"), ("min", "y_min", "p_min"),
                                                             ("max", "y_max", "p_max"))) -> DataFrame:
    """A5: unpivot (avg, min, max) target/prediction pairs into rows (target, y, yhat)."""
    parts = ", ".join(f"'{name}', {yc}, {pc}" for name, yc, pc in targets)
    return df.selectExpr(*keep, f"stack({len(targets)}, {parts}) AS (target, y, yhat)")


def multi_target_metrics(df: DataFrame, groups: Sequence[str] = ("split",)) -> DataFrame:
    """A5: metrics per group and target, in long form with the reference's metric names
    ``{split}_{metric}_{target}`` (single target is reported as ``_avg``)."""
    long = stack_targets(df, list(groups))
    m = regression_metrics(long, list(groups) + ["target"])
    metrics = ["mse", "mae", "r2", "rmse", "mape", "rrmse"]
    unp = m.selectExpr(*groups, "target",
                       f"stack({len(metrics)}, " + ", ".join(f"'{k}', {k}" for k in metrics) + ") AS (metric, value)")
    unp = unp.where(F.col("value").isNotNull())
    split_col = F.col("split") if "split" in groups else F.lit("val")
    return unp.withColumn("metric_name", F.concat_ws("_", split_col, F.col("metric"), F.col("target")))


def target_stats(df: DataFrame, groups: Sequence[str] = ("split",), y: str = "y") -> DataFrame:
    """A2: n, min, max, mean, std (ddof 0), variance (ddof 0), median per group."""
    groups = list(groups)
    base = df.groupBy(*groups).agg(
        F.count(y).alias("n"), F.min(y).alias("min"), F.max(y).alias("max"), F.avg(y).alias("mean"),
        F.stddev_pop(y).alias("std"), F.var_pop(y).alias("variance"))
    med = exact_percentiles(df, y, [0.5], groups, names=["median"])
    return base.join(med, groups, "left") if groups else _join_one(base, med)


def _join_one(a: DataFrame, b: DataFrame) -> DataFrame:
    """Attach the columns of a single-row global aggregate ``b`` to every row of ``a``.

    The row is fetched to the driver (one row, bounded) and added as literals, so no
    join - and no cross join - is planned."""
    r = b.first()
    vals = r.asDict() if r is not None else {c: None for c in b.columns}
    cols = []
    for f in b.schema.fields:
        v = vals.get(f.name)
        cols.append(F.lit(v).cast(f.dataType).alias(f.name))
    return a.select("*", *cols)


def scalar_row(df: DataFrame) -> dict:
    """Fetch a single aggregated row (bounded) to the driver."""
    r = df.first()
    return r.asDict() if r is not None else {}


def dummy_baselines(train: DataFrame, scored: DataFrame, y: str = "y") -> DataFrame:
    """Mean and median of the training target used as constant predictions, scored
    by MSE and MAE on ``scored`` (one row per baseline)."""
    stats = scalar_row(_join_one(train.agg(F.avg(y).alias("mean")),
                                 exact_percentiles(train, y, [0.5], names=["median"])))
    rows = []
    for name in ("mean", "median"):
        c = F.lit(stats[name])
        rows.append(scored.agg(F.avg((F.col(y) - c) ** 2).alias("mse"),
                               F.avg(F.abs(F.col(y) - c)).alias("mae"))
                    .select(F.lit(name).alias("baseline"), F.lit(stats[name]).alias("prediction"), "mse", "mae"))
    return rows[0].unionByName(rows[1])


def normalized_metrics(model_metrics: DataFrame, baselines: DataFrame, target_var: float) -> DataFrame:
    """MSE improvement (%) over the mean and median baselines and MSE / variance."""
    b = baselines.groupBy().pivot("baseline", ["mean", "median"]).agg(F.first("mse"))
    b = b.withColumnRenamed("mean", "mean_baseline_mse").withColumnRenamed("median", "median_baseline_mse")
    out = _join_one(model_metrics, b)
    return out.select(
        *model_metrics.columns,
        F.try_divide(F.col("mean_baseline_mse") - F.col("mse"), F.col("mean_baseline_mse") / 100.0)
        .alias("mean_mse_improvement_pct"),
        F.try_divide(F.col("median_baseline_mse") - F.col("mse"), F.col("median_baseline_mse") / 100.0)
        .alias("median_mse_improvement_pct"),
        F.try_divide(F.col("mse"), F.lit(target_var)).alias("mse_to_variance_ratio"))


def with_errors(df: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Residual ``err = actual - predicted`` (metrics-context sign)."""
    return df.withColumn("err", F.col(y) - F.col(yhat))


def error_stats(df: DataFrame, groups: Sequence[str] = (), err: str = "err") -> DataFrame:
    """Mean, median, std (ddof 0), min, max, mean |e| and percentiles 1/5/25/75/95/99."""
    groups = list(groups)
    base = df.groupBy(*groups).agg(
        F.avg(err).alias("mean"), F.stddev_pop(err).alias("std"), F.min(err).alias("min"),
        F.max(err).alias("max"), F.avg(F.abs(err)).alias("abs_mean"), F.count(err).alias("n"))
    probs = [0.5] + [p / 100.0 for p in ERROR_PERCENTILES]
    names = ["median"] + [f"p{p}" for p in ERROR_PERCENTILES]
    pct = exact_percentiles(df, err, probs, groups, names=names)
    return base.join(pct, groups, "inner") if groups else _join_one(base, pct)


def error_distribution(df: DataFrame, groups: Sequence[str] = (), y: str = "y", err: str = "err") -> DataFrame:
    """A10: share (%) of |err| below 1/5/10/20 % of the mean target, and precision level."""
    groups = list(groups)
    mean_y = df.groupBy(*groups).agg(F.avg(y).alias("target_mean"))
    j = df.join(mean_y, groups, "inner") if groups else _join_one(df, mean_y)
    aggs = [F.first("target_mean").alias("target_mean")]
    for p in WITHIN_PCTS:
        cond = F.abs(F.col(err)) < F.lit(p / 100.0) * F.col("target_mean")
        aggs.append((F.avg(F.when(cond, 1.0).otherwise(0.0)) * 100.0).alias(f"within_{p}pct_of_mean"))
    out = j.groupBy(*groups).agg(*aggs).where(F.col("target_mean") > 0)
    level = (F.when(F.col("within_5pct_of_mean") > 80, "very high")
             .when(F.col("within_10pct_of_mean") > 80, "high")
             .when(F.col("within_20pct_of_mean") > 80, "moderate").otherwise("low"))
    return out.withColumn("precision_level", level)


def outlier_bounds(df: DataFrame, groups: Sequence[str] = (), err: str = "err") -> DataFrame:
    """IQR and 3-sigma fences, the tighter of both, percentile fallback, zero
    forced inside, 10 % margin; plus the IQR outlier share (%)."""
    groups = list(groups)
    st = error_stats(df, groups, err)
    st = (st.withColumn("iqr", F.col("p75") - F.col("p25"))
          .withColumn("x_min0", F.greatest(F.col("mean") - 3 * F.col("std"), F.col("p25") - 1.5 * F.col("iqr")))
          .withColumn("x_max0", F.least(F.col("mean") + 3 * F.col("std"), F.col("p75") + 1.5 * F.col("iqr"))))
    j = df.join(st, groups, "inner") if groups else _join_one(df, st)
    e = F.col(err)
    shares = j.groupBy(*groups).agg(
        F.avg(F.when((e < F.col("x_min0")) | (e > F.col("x_max0")), 1.0).otherwise(0.0)).alias("excluded_share"),
        (F.avg(F.when((e < F.col("p25") - 1.5 * F.col("iqr")) | (e > F.col("p75") + 1.5 * F.col("iqr")), 1.0)
               .otherwise(0.0)) * 100.0).alias("outlier_pct"))
    out = st.join(shares, groups, "inner") if groups else _join_one(st, shares)
    fallback = (F.col("x_max0") - F.col("x_min0") < F.col("std")) | (F.col("excluded_share") > 0.05)
    out = (out.withColumn("x_min1", F.when(fallback, F.col("p1")).otherwise(F.col("x_min0")))
           .withColumn("x_max1", F.when(fallback, F.col("p99")).otherwise(F.col("x_max0"))))
    out = (out.withColumn("x_min2", F.when(F.col("x_min1") > 0, -0.1 * F.abs(F.col("x_max1")))
                          .otherwise(F.col("x_min1")))
           .withColumn("x_max2", F.when(F.col("x_max1") < 0, 0.1 * F.abs(F.col("x_min2")))
                       .otherwise(F.col("x_max1"))))
    margin = 0.1 * (F.col("x_max2") - F.col("x_min2"))
    return out.select(*groups, "p25", "p75", "iqr", "outlier_pct", fallback.alias("used_percentiles"),
                      (F.col("x_min2") - margin).alias("x_min"), (F.col("x_max2") + margin).alias("x_max"))


def residual_regression(df: DataFrame, groups: Sequence[str] = (), y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Least-squares line of residual on prediction and of prediction on actual."""
    err = F.col(y) - F.col(yhat)
    d = df.withColumn("_err", err)
    return d.groupBy(*groups).agg(
        F.regr_slope("_err", yhat).alias("resid_slope"),
        F.regr_intercept("_err", yhat).alias("resid_intercept"),
        F.corr("_err", yhat).alias("resid_r"),
        F.regr_r2("_err", yhat).alias("resid_r2"),
        F.regr_slope(yhat, y).alias("fit_slope"),
        F.regr_intercept(yhat, y).alias("fit_intercept"),
        F.corr(yhat, y).alias("fit_r"),
        F.regr_r2(yhat, y).alias("fit_r2"))


def error_histogram(df: DataFrame, groups: Sequence[str] = (), err: str = "err") -> DataFrame:
    """Equal-width histogram, n_bins = min(50, max(10, n // 20)), empty bins kept."""
    groups = list(groups)
    g = groups or ["_g"]
    d = df if groups else df.withColumn("_g", F.lit(0))
    rng = d.groupBy(*g).agg(F.min(err).alias("lo"), F.max(err).alias("hi"), F.count(err).alias("n"))
    rng = rng.withColumn("n_bins", F.least(F.lit(50), F.greatest(F.lit(10), F.floor(F.col("n") / 20))).cast("int"))
    width = (F.col("hi") - F.col("lo")) / F.col("n_bins")
    idx = F.when(F.col("hi") == F.col("lo"), 0).otherwise(
        F.least(F.floor((F.col(err) - F.col("lo")) * F.col("n_bins") / (F.col("hi") - F.col("lo"))),
                F.col("n_bins") - 1)).cast("int")
    counts = d.join(rng, g, "inner").withColumn("bin", idx).groupBy(*g, "bin").agg(F.count(F.lit(1)).alias("count"))
    spine = rng.select(*g, "lo", "hi", "n_bins", F.explode(F.sequence(F.lit(0), F.col("n_bins") - 1)).alias("bin"))
    out = (spine.join(counts, g + ["bin"], "left")
           .select(*g, "bin", (F.col("lo") + F.col("bin") * width).alias("bin_lo"),
                   (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_hi"),
                   F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count")))
    return out if groups else out.drop("_g")


def combined_loss(df: DataFrame, groups: Sequence[str] = (), y: str = "y", yhat: str = "yhat") -> DataFrame:
    """0.8 * MSE + 0.2 * MAE per group."""
    err = F.col(y) - F.col(yhat)
    wm, wa = COMBINED_LOSS_WEIGHTS
    return df.groupBy(*groups).agg((wm * F.avg(err * err) + wa * F.avg(F.abs(err))).alias("combined_loss"))


def prediction_residuals(df: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Visualisation residual ``predicted - actual`` per row."""
    return df.withColumn("residual", F.col(yhat) - F.col(y))


def align_predictions(df: DataFrame, models: Sequence[str], key: str = "row_id", model: str = "model",
                      pred: str = "yhat", y: str = "y") -> DataFrame:
    """Predictions of several models side by side on one key (explicit pivot values).
    A model whose row count differs from the reference model (the first) is dropped."""
    counts = df.groupBy(model).agg(F.count(F.lit(1)).alias("n"))
    ref = counts.where(F.col(model) == models[0]).select(F.col("n").alias("n_ref"))
    keep = counts.join(ref, F.col("n") == F.col("n_ref"), "inner").select(model).where(F.col(model).isin(list(models)))
    # rows meet by key before they are pivoted: a task's maps hold its share of the keys, not
    # all the distinct keys of an input split
    df = df.repartition(key)
    kept = df.join(F.broadcast(keep), model, "left_semi")
    wide = kept.groupBy(key).pivot(model, list(models)).agg(F.first(pred))
    actual = df.where(F.col(model) == models[0]).select(key, F.col(y).alias("actual"))
    return actual.join(wide, key, "inner")


def prediction_correlation(aligned: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation matrix in long form from a single aggregate."""
    pairs = [(a, b) for a in cols for b in cols]
    row = aligned.agg(*[F.corr(a, b).alias(f"{a}__{b}") for a, b in pairs])
    expr = ", ".join(f"'{a}', '{b}', `{a}__{b}`" for a, b in pairs)
    return row.selectExpr(f"stack({len(pairs)}, {expr}) AS (var_a, var_b, corr)")


def bootstrap_replicates(df: DataFrame, groups: Sequence[str], key: str = "row_id", y: str = "y",
                         yhat: str = "yhat", n_boot: int = 1000, seed: int = 42) -> DataFrame:
    """A22 (part 1): per group and replicate weighted metrics under Poisson(1) weights.

    Weight of (row, replicate) = inverse Poisson(1) CDF of the replicate's uniform in
    the row's random stream (integer key mixed with the seed).  The weights are a function of the row key only, so every target and
    model scored on the same rows sees the same resample.  Rows are never copied to
    a resampled table: each row contributes weighted sums to B partial aggregates.
    """
    groups = list(groups)
    rep = F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("rep")
    d = with_stream_seed(df.select(*groups, key, y, yhat), key, seed)
    d = with_stream_uniform(d.select(*groups, key, y, yhat, "_s", rep), "_s", "rep", "_u")
    u = F.col("_u")
    wexpr = None
    for c in POISSON1_CDF:
        term = F.when(u >= F.lit(c), 1).otherwise(0)
        wexpr = term if wexpr is None else wexpr + term
    # no filter on w > 0: zero weights add nothing to the sums, and a filter would be
    # pushed below the mixing projections and expand them into one huge predicate
    d = d.withColumn("w", wexpr.cast("double"))
    err = F.col(y) - F.col(yhat)
    agg = d.groupBy(*groups, "rep").agg(
        F.sum("w").alias("sw"), F.sum(F.col("w") * err * err).alias("sse"),
        F.sum(F.col("w") * F.abs(err)).alias("sae"), F.sum(F.col("w") * F.col(y)).alias("swy"),
        F.sum(F.col("w") * F.col(y) * F.col(y)).alias("swyy"))
    sst = F.col("swyy") - F.col("swy") * F.col("swy") / F.col("sw")
    return agg.select(*groups, "rep", (F.col("sse") / F.col("sw")).alias("mse"),
                      (F.col("sae") / F.col("sw")).alias("mae"),
                      _r2(F.col("sse"), sst).alias("r2"),
                      F.sqrt(F.col("sse") / F.col("sw")).alias("rmse"))


def _poisson_partial_sums(groups: list[str], key: str, y: str, yhat: str, n_boot: int, seed: int,
                          chunk_rows: int = 256):
    """mapInPandas body: per batch and group, the B weighted partial sums, with the same
    integer random stream as :func:`respan.functions.hashing.with_stream_uniform`: 32-bit
    integers that wrap around, compared with the CDF scaled by 2**32 and rounded up, which decides alike."""
    import numpy as np
    import pandas as pd

    from respan.functions.hashing import GOLDEN32, MIX32_MULT, MOD32

    edges = [np.uint32(c) for c in (math.ceil(c * MOD32) for c in POISSON1_CDF) if c < MOD32]
    steps = np.arange(n_boot, dtype=np.uint32) * np.uint32(GOLDEN32)

    def mix(x):
        for step in range(3):
            x ^= x >> np.uint32(16)
            if step < 2:
                x *= np.uint32(MIX32_MULT)
        return x

    def run(batches):
        sums = {}  # one set of B sums for each group of the task, whatever its batches
        for pdf in batches:
            if not len(pdf):
                continue
            for gkey, sub in (pdf.groupby(groups, sort=False) if groups else [((), pdf)]):
                gk = gkey if isinstance(gkey, tuple) else (gkey,)
                acc = sums.setdefault(gk, np.zeros((5, n_boot)))
                k = np.mod(sub[key].to_numpy(dtype=np.int64), MOD32).astype(np.uint32)
                s0 = mix(k + np.uint32(seed * GOLDEN32 % MOD32))
                yy = sub[y].to_numpy(dtype=float)
                e = yy - sub[yhat].to_numpy(dtype=float)
                cols = np.vstack([np.ones_like(e), e * e, np.abs(e), yy, yy * yy])
                for i in range(0, len(sub), chunk_rows):
                    sl = slice(i, i + chunk_rows)
                    x = mix(s0[sl, None] + steps[None, :])
                    w = np.zeros(x.shape, np.uint8)
                    for edge in edges:
                        w += x >= edge
                    acc += cols[:, sl] @ w.astype(float)
        for gk, acc in sums.items():
            out = {g: [v] * n_boot for g, v in zip(groups, gk)}
            out.update({"rep": np.arange(n_boot, dtype=np.int32), "sw": acc[0], "sse": acc[1], "sae": acc[2],
                        "swy": acc[3], "swyy": acc[4]})
            yield pd.DataFrame(out)
    return run


def bootstrap_replicates_arrow(df: DataFrame, groups: Sequence[str], key: str = "row_id", y: str = "y",
                               yhat: str = "yhat", n_boot: int = 1000, seed: int = 42) -> DataFrame:
    """A22 (part 1), vectorised: the same Poisson weights as :func:`bootstrap_replicates`
    computed as (rows x B) integer matrices in numpy, chunk by chunk, inside mapInPandas;
    each task emits B partial-sum rows per group, summed by one grouped aggregate.
    Rows are never replicated through Spark, so the shuffle carries B rows per group
    and task instead of B rows per input row."""
    groups = list(groups)
    gschema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*groups).schema.fields)
    schema = (gschema + ", " if gschema else "") + "rep int, sw double, sse double, sae double, swy double, swyy double"
    parts = df.select(*groups, key, y, yhat).mapInPandas(_poisson_partial_sums(groups, key, y, yhat, n_boot, seed),
                                                         schema)
    agg = parts.groupBy(*groups, "rep").agg(*[F.sum(c).alias(c) for c in ["sw", "sse", "sae", "swy", "swyy"]])
    sst = F.col("swyy") - F.col("swy") * F.col("swy") / F.col("sw")
    return agg.select(*groups, "rep", (F.col("sse") / F.col("sw")).alias("mse"),
                      (F.col("sae") / F.col("sw")).alias("mae"),
                      _r2(F.col("sse"), sst).alias("r2"),
                      F.sqrt(F.col("sse") / F.col("sw")).alias("rmse"))


def bootstrap_ci(df: DataFrame, groups: Sequence[str], key: str = "row_id", y: str = "y", yhat: str = "yhat",
                 n_boot: int = 1000, alpha: float = 0.05, seed: int = 42, vectorised: bool = True) -> DataFrame:
    """A22 + A23: percentile CI (alpha/2, 1-alpha/2) of mse/mae/r2/rmse and its width.
    Each (group, metric) holds only ``n_boot`` values, so the exact percentile is cheap."""
    groups = list(groups)
    build = bootstrap_replicates_arrow if vectorised else bootstrap_replicates
    reps = build(df, groups, key, y, yhat, n_boot, seed)
    long = reps.selectExpr(*groups, "stack(4, 'mse', mse, 'mae', mae, 'r2', r2, 'rmse', rmse) AS (metric, value)")
    lo, hi = alpha / 2, 1 - alpha / 2
    out = long.groupBy(*groups, "metric").agg(
        F.percentile("value", F.lit(lo)).alias("ci_lower"), F.percentile("value", F.lit(hi)).alias("ci_upper"))
    return out.withColumn("ci_width", F.col("ci_upper") - F.col("ci_lower"))


def mse_vs_baselines(model_metrics: DataFrame, baselines: DataFrame, name_col: str = "model") -> DataFrame:
    """Model MSEs next to the mean/median baseline MSEs as one bar table."""
    a = model_metrics.select(F.col(name_col).cast("string").alias("name"), F.lit("model").alias("kind"), "mse")
    b = baselines.select(F.concat(F.col("baseline"), F.lit("_baseline")).alias("name"),
                         F.lit("baseline").alias("kind"), "mse")
    return a.unionByName(b)


def effect_size(a: Column, b: Column) -> Column:
    base = F.greatest(F.abs(a), F.abs(b))
    return F.when(base == 0, F.lit(0.0)).otherwise(F.abs(a - b) / base)


def compare_models(metrics: DataFrame, model: str = "model", metric: str = "metric", value: str = "value",
                   ci: bool = True) -> DataFrame:
    """M13 + J8: pairwise comparison of models on each metric (model a < model b).

    The model set is an experiment dimension (a handful of fitted models), so the pair
    table is small by construction; rows of data never enter this join.
    """
    a = metrics.alias("a")
    b = metrics.alias("b")
    j = a.join(b, (F.col(f"a.{metric}") == F.col(f"b.{metric}")) & (F.col(f"a.{model}") < F.col(f"b.{model}")))
    cols = [F.col(f"a.{metric}").alias("metric"), F.col(f"a.{model}").alias("model_a"),
            F.col(f"b.{model}").alias("model_b"), F.col(f"a.{value}").alias("value_a"),
            F.col(f"b.{value}").alias("value_b"),
            (F.col(f"a.{value}") - F.col(f"b.{value}")).alias("difference"),
            effect_size(F.col(f"a.{value}"), F.col(f"b.{value}")).alias("effect_size")]
    if ci:
        has = (F.col("a.ci_lower").isNotNull() & F.col("b.ci_lower").isNotNull())
        overlap = ~((F.col("a.ci_upper") < F.col("b.ci_lower")) | (F.col("b.ci_upper") < F.col("a.ci_lower")))
        cols += [F.when(has, overlap).alias("ci_overlap"),
                 F.when(has, F.when(overlap, 0.05).otherwise(0.01)).alias("p_value"),
                 F.when(has, ~overlap).alias("significant")]
    return j.select(*cols)


def interpret_metrics(df: DataFrame) -> DataFrame:
    """Threshold interpretation of a metric row.

    Expects columns ``mse``, ``mae``, ``mean_baseline_mse``, ``target_mean`` and
    ``bias`` (mean of actual - predicted); adds the reference's categorical labels.
    """
    imp = F.when(F.col("mean_baseline_mse") > 0,
                 (F.col("mean_baseline_mse") - F.col("mse")) / F.col("mean_baseline_mse") * 100.0).otherwise(0.0)
    ratio = F.when(F.col("target_mean") > 0, F.col("mae") / F.col("target_mean") * 100.0).otherwise(0.0)
    d = df.withColumn("improvement_pct", imp).withColumn("mae_ratio_pct", ratio)
    i, r = F.col("improvement_pct"), F.col("mae_ratio_pct")
    mse_label = (F.when(i > 80, "excellent").when(i > 50, "good").when(i > 20, "moderate")
                 .when(i > 0, "slight").otherwise("poor"))
    mae_label = (F.when(r < 5, "excellent").when(r < 10, "good").when(r < 20, "acceptable")
                 .when(r < 50, "moderate").otherwise("poor"))
    overall = (F.when((i > 50) & (r < 10), "excellent").when((i > 30) & (r < 20), "good")
               .when((i > 10) & (r < 50), "acceptable").when(i > 0, "marginal").otherwise("suboptimal"))
    mae = F.col("mae")
    practical = (F.when(mae < 0.1, "precise").when(mae < 0.5, "production").when(mae < 1.0, "trend")
                 .otherwise("rough"))
    bias = (F.when(F.col("bias") > 0.05, "overestimates").when(F.col("bias") < -0.05, "underestimates")
            .otherwise("minimal"))
    return (d.withColumn("mse_interpretation", mse_label).withColumn("mae_interpretation", mae_label)
            .withColumn("performance_level", overall).withColumn("practical_significance", practical)
            .withColumn("bias_direction", bias))


def cv_summary(fold_scores: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Per metric mean/std (ddof 0) of test scores, 2.5/97.5 percentiles, train mean and
    the generalisation gap.  ``fold_scores``: (fold, metric, train_score, test_score), with
    ``neg_`` metrics already flipped.  A fold table has k rows per metric."""
    groups = list(groups)
    return (fold_scores.groupBy(*groups, "metric").agg(
        F.avg("test_score").alias("test_mean"), F.stddev_pop("test_score").alias("test_std"),
        F.avg("train_score").alias("train_mean"), F.stddev_pop("train_score").alias("train_std"),
        F.percentile("test_score", F.lit(0.025)).alias("test_ci_lower"),
        F.percentile("test_score", F.lit(0.975)).alias("test_ci_upper"))
        .withColumn("generalization_gap", F.col("train_mean") - F.col("test_mean")))


def window_rank(df: DataFrame, part: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*part).orderBy(*order)))
