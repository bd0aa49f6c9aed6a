"""Registered queries: ingest slice (S1-P2-J1-J2-A1-W1) and the evaluation family."""

from __future__ import annotations

from pyspark.sql import functions as F

from respan import catalog as C
from respan.catalog import with_fixtures
from respan.operators import metrics as M
from respan.operators import samples as S
from respan.operators.split import exact_split, split_sql
from respan.plans.registry import r6, register

# ----------------------------------------------------------------------------- ingest slice

_SAMPLES_SQL = """
samples AS (
  SELECT d.base_name, m.avg_resp_time, m.min_resp_time, m.max_resp_time, m.n_measurements
  FROM dsl_docs d JOIN (
    SELECT base_name, avg(response_time) AS avg_resp_time, min(response_time) AS min_resp_time,
           max(response_time) AS max_resp_time, count(*) AS n_measurements
    FROM measurements WHERE response_time IS NOT NULL GROUP BY base_name) m
  ON d.base_name = m.base_name)
"""


def _samples(spark, sf):
    return S.summary_samples(C.dsl_docs(spark, sf), C.measurements(spark, sf))


def _fx(body: str, *names: str, extra: str = "") -> str:
    if not names:
        return ("WITH " + extra.strip() + "\n" + body) if extra else body
    sql = with_fixtures("", *names)
    if extra:
        sql = sql.rstrip() + ",\n" + extra.strip() + "\n"
    return sql + body


@register("drop_null_measurements", _fx(
    "SELECT base_name, row_id, response_time FROM measurements WHERE response_time IS NOT NULL",
    "measurements"))
def q_drop_null(spark, sf):
    return S.drop_null_measurements(C.measurements(spark, sf)).select("base_name", "row_id", "response_time")


@register("summary_samples", _fx(
    f"SELECT base_name, {r6('avg(response_time)', 'avg_resp_time')}, min(response_time) AS min_resp_time, "
    "max(response_time) AS max_resp_time, count(*) AS n_measurements FROM measurements "
    "WHERE response_time IS NOT NULL GROUP BY base_name", "measurements"))
def q_summary_targets(spark, sf):
    return S.summary_targets(C.measurements(spark, sf))


@register("pair_documents", _fx(
    f"SELECT base_name, {r6('avg_resp_time', 'avg_resp_time')}, min_resp_time, max_resp_time, n_measurements "
    "FROM samples", "dsl_docs", "measurements", extra=_SAMPLES_SQL))
def q_pair_documents(spark, sf):
    return _samples(spark, sf)


@register("timeseries_samples", _fx(
    "SELECT base_name, row_id, point_in_time AS time_value, response_time FROM measurements m "
    "WHERE response_time IS NOT NULL AND point_in_time IS NOT NULL "
    "AND base_name IN (SELECT base_name FROM dsl_docs)", "dsl_docs", "measurements"))
def q_timeseries(spark, sf):
    return S.timeseries_samples(C.dsl_docs(spark, sf), C.measurements(spark, sf))


@register("split_70_15_15", _fx(
    "SELECT base_name, split FROM (" + split_sql("samples", ["base_name"]) + ")",
    "dsl_docs", "measurements", extra=_SAMPLES_SQL))
def q_split(spark, sf):
    return exact_split(_samples(spark, sf), ["base_name"]).select("base_name", "split")


@register("split_timeseries", _fx(
    "SELECT row_id, split FROM (" + split_sql("ts", ["row_id"], "timeseries") + ")",
    "dsl_docs", "measurements",
    extra="ts AS (SELECT row_id FROM measurements WHERE response_time IS NOT NULL AND point_in_time IS NOT NULL "
          "AND base_name IN (SELECT base_name FROM dsl_docs))"))
def q_split_ts(spark, sf):
    ts = S.timeseries_samples(C.dsl_docs(spark, sf), C.measurements(spark, sf))
    return exact_split(ts, ["row_id"], "timeseries").select("row_id", "split")


@register("split_variants", _fx(
    "SELECT row_id, 'a_80_10_10' AS layout, split FROM (" + split_sql("p", ["row_id"], "80_10_10") + ") "
    "UNION ALL SELECT row_id, 'b_90_10' AS layout, split FROM (" + split_sql("p", ["row_id"], "90_10", seed=7) + ")",
    "predictions", extra="p AS (SELECT row_id FROM predictions)"))
def q_split_variants(spark, sf):
    p = C.predictions(spark, sf).select("row_id")
    a = exact_split(p, ["row_id"], "80_10_10").withColumn("layout", F.lit("a_80_10_10"))
    b = exact_split(p, ["row_id"], "90_10", seed=7).withColumn("layout", F.lit("b_90_10"))
    return a.unionByName(b).select("row_id", "layout", "split")


_MEAN_BASELINE_SQL = _fx(
    f"""SELECT split, count(*) AS n, {r6('avg((avg_resp_time - tm) ^ 2)', 'mse')},
       {r6('avg(abs(avg_resp_time - tm))', 'mae')}, {r6('sqrt(avg((avg_resp_time - tm) ^ 2))', 'rmse')},
       {r6('''CASE WHEN var_pop(avg_resp_time) = 0 THEN CASE WHEN sum((avg_resp_time - tm) ^ 2) = 0 THEN 1.0 ELSE 0.0 END
            ELSE 1 - sum((avg_resp_time - tm) ^ 2) / (var_pop(avg_resp_time) * count(*)) END''', 'r2')}
    FROM (SELECT *, avg(CASE WHEN split = 'train' THEN avg_resp_time END) OVER () AS tm FROM splits)
    GROUP BY split""",
    "dsl_docs", "measurements",
    extra=_SAMPLES_SQL + ", splits AS (" + split_sql("samples", ["base_name"]) + ")")


def mean_baseline_metrics(spark, sf):
    """Flagship slice: pair -> aggregate -> exact split -> train-mean baseline -> metrics."""
    samples = exact_split(_samples(spark, sf), ["base_name"])
    train_mean = M.scalar_row(samples.where(F.col("split") == "train").agg(F.avg("avg_resp_time").alias("m")))["m"]
    scored = samples.withColumn("yhat", F.lit(train_mean))
    return M.regression_metrics(scored, ["split"], y="avg_resp_time", relative=False)


register("mean_baseline_metrics", _MEAN_BASELINE_SQL)(mean_baseline_metrics)

# ----------------------------------------------------------------------------- evaluation family

_MP = "model_predictions"


def _mp(spark, sf):
    return C.model_predictions(spark, sf)


_R2_SQL = ("CASE WHEN var_pop(y) = 0 THEN CASE WHEN sum((y - yhat) ^ 2) = 0 THEN 1.0 ELSE 0.0 END "
           "ELSE 1 - sum((y - yhat) ^ 2) / (var_pop(y) * count(*)) END")
_METRIC_COLS_SQL = (f"count(*) AS n, {r6('avg((y - yhat) ^ 2)', 'mse')}, {r6('avg(abs(y - yhat))', 'mae')}, "
                    f"{r6('sqrt(avg((y - yhat) ^ 2))', 'rmse')}, {r6(_R2_SQL, 'r2')}")
_REL_SQL = (f"{r6('CASE WHEN avg(y) <> 0 AND avg(CASE WHEN abs(y) > 1e-6 THEN abs((y - yhat) / y) END) IS NOT NULL THEN least(avg(CASE WHEN abs(y) > 1e-6 THEN abs((y - yhat) / y) END) * 100.0, 1000.0) END', 'mape')}, "
            f"{r6('CASE WHEN avg(y) <> 0 THEN sqrt(avg((y - yhat) ^ 2)) / avg(y) * 100.0 END', 'rrmse')}")


@register("regression_metrics", _fx(
    f"SELECT split, model, {_METRIC_COLS_SQL} FROM {_MP} GROUP BY split, model", _MP))
def q_regression_metrics(spark, sf):
    return M.regression_metrics(_mp(spark, sf), ["split", "model"], relative=False)


@register("relative_metrics", _fx(f"SELECT split, model, {_REL_SQL} FROM {_MP} GROUP BY split, model", _MP))
def q_relative_metrics(spark, sf):
    return M.regression_metrics(_mp(spark, sf), ["split", "model"]).select("split", "model", "mape", "rrmse")


_STACK_SQL = """
long AS (
  SELECT split, 'avg' AS target, y, yhat FROM predictions
  UNION ALL SELECT split, 'min', y_min, p_min FROM predictions
  UNION ALL SELECT split, 'max', y_max, p_max FROM predictions),
m AS (SELECT split, target, avg((y - yhat) ^ 2) AS mse, avg(abs(y - yhat)) AS mae,
        sqrt(avg((y - yhat) ^ 2)) AS rmse,
        """ + _R2_SQL + """ AS r2,
        CASE WHEN avg(y) <> 0 AND avg(CASE WHEN abs(y) > 1e-6 THEN abs((y - yhat) / y) END) IS NOT NULL THEN least(avg(CASE WHEN abs(y) > 1e-6 THEN abs((y - yhat) / y) END) * 100.0, 1000.0) END AS mape,
        CASE WHEN avg(y) <> 0 THEN sqrt(avg((y - yhat) ^ 2)) / avg(y) * 100.0 END AS rrmse
      FROM long GROUP BY split, target)
"""


@register("multi_target_metrics", _fx(
    "SELECT metric_name, " + r6("value", "value") + " FROM (SELECT split || '_' || metric || '_' || target AS metric_name, value "
    "FROM (UNPIVOT m ON mse, mae, r2, rmse, mape, rrmse INTO NAME metric VALUE value)) WHERE value IS NOT NULL",
    "predictions", extra=_STACK_SQL))
def q_multi_target(spark, sf):
    return M.multi_target_metrics(C.predictions(spark, sf), ["split"]).select("metric_name", "value")


@register("target_stats", _fx(
    f"SELECT split, count(y) AS n, min(y) AS min, max(y) AS max, {r6('avg(y)', 'mean')}, "
    f"{r6('stddev_pop(y)', 'std')}, {r6('var_pop(y)', 'variance')}, {r6('median(y)', 'median')} "
    "FROM predictions GROUP BY split", "predictions"))
def q_target_stats(spark, sf):
    return M.target_stats(C.predictions(spark, sf), ["split"])


_BASELINE_SQL = """
tr AS (SELECT avg(y) AS mean, median(y) AS median FROM predictions WHERE split = 'train'),
bl AS (
  SELECT 'mean' AS baseline, tr.mean AS prediction, avg((y - tr.mean) ^ 2) AS mse, avg(abs(y - tr.mean)) AS mae
  FROM predictions, tr WHERE split = 'val' GROUP BY tr.mean
  UNION ALL
  SELECT 'median', tr.median, avg((y - tr.median) ^ 2), avg(abs(y - tr.median))
  FROM predictions, tr WHERE split = 'val' GROUP BY tr.median)
"""


def _baselines(spark, sf):
    p = C.predictions(spark, sf)
    return M.dummy_baselines(p.where(F.col("split") == "train"), p.where(F.col("split") == "val"))


@register("dummy_baselines", _fx(
    f"SELECT baseline, {r6('prediction', 'prediction')}, {r6('mse', 'mse')}, {r6('mae', 'mae')} FROM bl",
    "predictions", extra=_BASELINE_SQL))
def q_dummy_baselines(spark, sf):
    return _baselines(spark, sf)


@register("normalized_metrics", _fx(
    f"""SELECT mm.model, {r6('mm.mse', 'mse')},
        {r6("(b1.mse - mm.mse) / (b1.mse / 100.0)", 'mean_mse_improvement_pct')},
        {r6("(b2.mse - mm.mse) / (b2.mse / 100.0)", 'median_mse_improvement_pct')},
        {r6("mm.mse / (SELECT var_pop(y) FROM predictions WHERE split = 'train')", 'mse_to_variance_ratio')}
      FROM (SELECT model, avg((y - yhat) ^ 2) AS mse FROM predictions WHERE split = 'val' GROUP BY model) mm,
           bl b1, bl b2 WHERE b1.baseline = 'mean' AND b2.baseline = 'median'""",
    "predictions", extra=_BASELINE_SQL))
def q_normalized_metrics(spark, sf):
    p = C.predictions(spark, sf)
    var = M.scalar_row(p.where(F.col("split") == "train").agg(F.var_pop("y").alias("v")))["v"]
    mm = M.regression_metrics(p.where(F.col("split") == "val"), ["model"], relative=False).select("model", "mse")
    return M.normalized_metrics(mm, _baselines(spark, sf), var)


_ERR_SQL = "e AS (SELECT split, model, y, yhat, y - yhat AS err FROM model_predictions)"


@register("error_stats", _fx(
    f"SELECT split, model, {r6('avg(err)', 'mean')}, {r6('stddev_pop(err)', 'std')}, {r6('min(err)', 'min')}, "
    f"{r6('max(err)', 'max')}, {r6('avg(abs(err))', 'abs_mean')}, count(err) AS n, {r6('median(err)', 'median')}, "
    + ", ".join(r6(f"quantile_cont(err, {p / 100.0})", f"p{p}") for p in M.ERROR_PERCENTILES)
    + " FROM e GROUP BY split, model", _MP, extra=_ERR_SQL))
def q_error_stats(spark, sf):
    return M.error_stats(M.with_errors(_mp(spark, sf)), ["split", "model"])


@register("error_distribution", _fx(
    "SELECT split, model, " + r6("avg(y)", "target_mean") + ", "
    + ", ".join(r6(f"avg(CASE WHEN abs(err) < {p / 100.0} * tm THEN 1.0 ELSE 0.0 END) * 100.0", f"within_{p}pct_of_mean")
                for p in M.WITHIN_PCTS)
    + ", CASE WHEN avg(CASE WHEN abs(err) < 0.05 * tm THEN 1.0 ELSE 0.0 END) * 100.0 > 80 THEN 'very high' "
      "WHEN avg(CASE WHEN abs(err) < 0.1 * tm THEN 1.0 ELSE 0.0 END) * 100.0 > 80 THEN 'high' "
      "WHEN avg(CASE WHEN abs(err) < 0.2 * tm THEN 1.0 ELSE 0.0 END) * 100.0 > 80 THEN 'moderate' ELSE 'low' END "
      "AS precision_level FROM (SELECT *, avg(y) OVER (PARTITION BY split, model) AS tm FROM e) "
      "GROUP BY split, model HAVING avg(y) > 0", _MP, extra=_ERR_SQL))
def q_error_distribution(spark, sf):
    return M.error_distribution(M.with_errors(_mp(spark, sf)), ["split", "model"])


@register("outlier_bounds", _fx(
    """SELECT split, model, """ + r6("p25", "p25") + ", " + r6("p75", "p75") + ", " + r6("iqr", "iqr") + ", "
    + r6("outlier_pct", "outlier_pct") + """, used_percentiles,
       """ + r6("x_min2 - 0.1 * (x_max2 - x_min2)", "x_min") + ", " + r6("x_max2 + 0.1 * (x_max2 - x_min2)", "x_max") + """
    FROM (SELECT *, CASE WHEN x_max1 < 0 THEN 0.1 * abs(x_min2) ELSE x_max1 END AS x_max2 FROM (
      SELECT *, CASE WHEN x_min1 > 0 THEN -0.1 * abs(x_max1) ELSE x_min1 END AS x_min2 FROM (
        SELECT *, CASE WHEN used_percentiles THEN p1 ELSE x_min0 END AS x_min1,
                  CASE WHEN used_percentiles THEN p99 ELSE x_max0 END AS x_max1 FROM (
          SELECT *, (x_max0 - x_min0 < std) OR (excluded_share > 0.05) AS used_percentiles FROM (
            SELECT s.*, avg(CASE WHEN err < x_min0 OR err > x_max0 THEN 1.0 ELSE 0.0 END) AS excluded_share,
                   avg(CASE WHEN err < p25 - 1.5 * iqr OR err > p75 + 1.5 * iqr THEN 1.0 ELSE 0.0 END) * 100.0 AS outlier_pct
            FROM e JOIN s USING (split, model) GROUP BY ALL)))))""",
    _MP, extra=_ERR_SQL + """,
    s0 AS (SELECT split, model, avg(err) AS mean, stddev_pop(err) AS std, quantile_cont(err, 0.25) AS p25,
                  quantile_cont(err, 0.75) AS p75, quantile_cont(err, 0.01) AS p1, quantile_cont(err, 0.99) AS p99
           FROM e GROUP BY split, model),
    s AS (SELECT *, p75 - p25 AS iqr, greatest(mean - 3 * std, p25 - 1.5 * (p75 - p25)) AS x_min0,
                 least(mean + 3 * std, p75 + 1.5 * (p75 - p25)) AS x_max0 FROM s0)"""))
def q_outlier_bounds(spark, sf):
    return M.outlier_bounds(M.with_errors(_mp(spark, sf)), ["split", "model"])


@register("residual_regression", _fx(
    "SELECT split, model, "
    + ", ".join([r6("regr_slope(err, yhat)", "resid_slope"), r6("regr_intercept(err, yhat)", "resid_intercept"),
                 r6("corr(err, yhat)", "resid_r"), r6("regr_r2(err, yhat)", "resid_r2"),
                 r6("regr_slope(yhat, y)", "fit_slope"), r6("regr_intercept(yhat, y)", "fit_intercept"),
                 r6("corr(yhat, y)", "fit_r"), r6("regr_r2(yhat, y)", "fit_r2")])
    + " FROM e GROUP BY split, model", _MP, extra=_ERR_SQL))
def q_residual_regression(spark, sf):
    return M.residual_regression(_mp(spark, sf), ["split", "model"])


@register("error_histogram", _fx(
    f"""SELECT s.split, s.model, s.bin, {r6('lo + bin * (hi - lo) / n_bins', 'bin_lo')},
        {r6('lo + (bin + 1) * (hi - lo) / n_bins', 'bin_hi')}, CAST(coalesce(c.cnt, 0) AS BIGINT) AS count
    FROM (SELECT split, model, lo, hi, n_bins, CAST(unnest(range(0, n_bins)) AS INTEGER) AS bin FROM r) s
    LEFT JOIN c USING (split, model, bin)""",
    _MP, extra=_ERR_SQL + """,
    r AS (SELECT split, model, min(err) AS lo, max(err) AS hi,
                 CAST(least(50, greatest(10, floor(count(err) / 20))) AS INTEGER) AS n_bins FROM e GROUP BY split, model),
    c AS (SELECT split, model, CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((err - lo) * n_bins / (hi - lo)), n_bins - 1) END AS INTEGER) AS bin,
                 count(*) AS cnt FROM e JOIN r USING (split, model) GROUP BY ALL)"""))
def q_error_histogram(spark, sf):
    return M.error_histogram(M.with_errors(_mp(spark, sf)), ["split", "model"])


@register("combined_loss", _fx(
    f"SELECT split, model, {r6('0.8 * avg((y - yhat) ^ 2) + 0.2 * avg(abs(y - yhat))', 'combined_loss')} "
    f"FROM {_MP} GROUP BY split, model", _MP))
def q_combined_loss(spark, sf):
    return M.combined_loss(_mp(spark, sf), ["split", "model"])


@register("prediction_residuals", _fx(
    f"SELECT row_id, model, split, {r6('y', 'y')}, {r6('yhat', 'yhat')}, {r6('yhat - y', 'residual')} FROM {_MP}", _MP))
def q_prediction_residuals(spark, sf):
    return M.prediction_residuals(_mp(spark, sf)).select("row_id", "model", "split", "y", "yhat", "residual")


_ALIGN_SQL = """
cnt AS (SELECT model, count(*) AS n FROM model_predictions GROUP BY model),
keep AS (SELECT model FROM cnt WHERE n = (SELECT n FROM cnt WHERE model = 'm0')),
al AS (SELECT row_id, max(CASE WHEN model = 'm0' THEN y END) AS actual,
              max(CASE WHEN model = 'm0' AND model IN (SELECT model FROM keep) THEN yhat END) AS m0,
              max(CASE WHEN model = 'm1' AND model IN (SELECT model FROM keep) THEN yhat END) AS m1,
              max(CASE WHEN model = 'm2' AND model IN (SELECT model FROM keep) THEN yhat END) AS m2
       FROM model_predictions GROUP BY row_id HAVING max(CASE WHEN model = 'm0' THEN 1 END) = 1)
"""


@register("align_predictions", _fx(
    f"SELECT row_id, {r6('actual', 'actual')}, {r6('m0', 'm0')}, {r6('m1', 'm1')}, {r6('m2', 'm2')} FROM al",
    _MP, extra=_ALIGN_SQL))
def q_align(spark, sf):
    return M.align_predictions(_mp(spark, sf), ["m0", "m1", "m2"])


@register("prediction_correlation", _fx(
    "SELECT var_a, var_b, " + r6("c", "corr") + " FROM (SELECT unnest(["
    + ", ".join(f"{{'var_a': '{a}', 'var_b': '{b}', 'c': corr({a}, {b})}}"
                for a in ("actual", "m0", "m1") for b in ("actual", "m0", "m1"))
    + "], recursive := true) FROM al)", _MP, extra=_ALIGN_SQL))
def q_correlation(spark, sf):
    al = M.align_predictions(_mp(spark, sf), ["m0", "m1", "m2"])
    return M.prediction_correlation(al, ["actual", "m0", "m1"])


# ----------------------------------------------------------------------------- bootstrap, comparison

from respan.functions import hashing as _H  # noqa: E402

_N_BOOT = 1000  # reference default B
_POISSON_SQL = " + ".join(f"CASE WHEN u >= {c!r} THEN 1 ELSE 0 END" for c in M.POISSON1_CDF)
_BOOT_SQL = f"""
bw AS (SELECT split, model, y, yhat, ({_POISSON_SQL}) AS w, rep FROM (
         SELECT split, model, y, yhat, rep, {_H.sql_stream_uniform('s32', 'rep')} AS u
         FROM (SELECT *, {_H.sql_stream_seed('row_id')} AS s32 FROM model_predictions),
              range(0, {_N_BOOT}) t(rep))),
reps AS (SELECT split, model, rep, sum(w * (y - yhat) ^ 2) / sum(w) AS mse, sum(w * abs(y - yhat)) / sum(w) AS mae,
                sqrt(sum(w * (y - yhat) ^ 2) / sum(w)) AS rmse,
                CASE WHEN sum(w * y * y) - sum(w * y) * sum(w * y) / sum(w) = 0
                     THEN CASE WHEN sum(w * (y - yhat) ^ 2) = 0 THEN 1.0 ELSE 0.0 END
                     ELSE 1 - sum(w * (y - yhat) ^ 2) / (sum(w * y * y) - sum(w * y) * sum(w * y) / sum(w)) END AS r2
         FROM bw WHERE w > 0 GROUP BY split, model, rep),
ci AS (SELECT split, model, metric, quantile_cont(value, 0.025) AS ci_lower, quantile_cont(value, 0.975) AS ci_upper
       FROM (UNPIVOT reps ON mse, mae, r2, rmse INTO NAME metric VALUE value) GROUP BY split, model, metric)
"""


def _boot(spark, sf):
    return M.bootstrap_ci(_mp(spark, sf), ["split", "model"], n_boot=_N_BOOT)


@register("bootstrap_ci", _fx(
    f"SELECT split, model, metric, {r6('ci_lower', 'ci_lower')}, {r6('ci_upper', 'ci_upper')}, "
    f"{r6('ci_upper - ci_lower', 'ci_width')} FROM ci", _MP, extra=_BOOT_SQL))
def q_bootstrap_ci(spark, sf):
    return _boot(spark, sf)


@register("ci_width", _fx(
    f"SELECT split || '_' || metric || '_avg' AS metric_name, model, {r6('ci_lower', 'ci_lower')}, "
    f"{r6('ci_upper', 'ci_upper')}, {r6('ci_upper - ci_lower', 'ci_width')} FROM ci", _MP, extra=_BOOT_SQL))
def q_ci_width(spark, sf):
    """CI triple logged as ``{split}_{metric}_avg_ci_lower/_upper/_width``."""
    b = _boot(spark, sf)
    return b.select(F.concat_ws("_", "split", "metric", F.lit("avg")).alias("metric_name"), "model",
                    "ci_lower", "ci_upper", "ci_width")


_PM_SQL = _BOOT_SQL + """,
pm AS (SELECT split, model, metric, value FROM (UNPIVOT (
         SELECT split, model, avg((y - yhat) ^ 2) AS mse, avg(abs(y - yhat)) AS mae, sqrt(avg((y - yhat) ^ 2)) AS rmse,
                """ + _R2_SQL + """ AS r2
         FROM model_predictions GROUP BY split, model)
       ON mse, mae, r2, rmse INTO NAME metric VALUE value)),
pmc AS (SELECT pm.split, pm.model, pm.split || '_' || pm.metric || '_avg' AS metric, pm.value, ci.ci_lower, ci.ci_upper
        FROM pm JOIN ci USING (split, model, metric))
"""


@register("compare_models", _fx(
    f"""SELECT a.metric, a.model AS model_a, b.model AS model_b, {r6('a.value', 'value_a')}, {r6('b.value', 'value_b')},
        {r6('a.value - b.value', 'difference')},
        {r6('CASE WHEN greatest(abs(a.value), abs(b.value)) = 0 THEN 0.0 ELSE abs(a.value - b.value) / greatest(abs(a.value), abs(b.value)) END', 'effect_size')},
        NOT (a.ci_upper < b.ci_lower OR b.ci_upper < a.ci_lower) AS ci_overlap,
        {r6('CASE WHEN NOT (a.ci_upper < b.ci_lower OR b.ci_upper < a.ci_lower) THEN 0.05 ELSE 0.01 END', 'p_value')},
        (a.ci_upper < b.ci_lower OR b.ci_upper < a.ci_lower) AS significant
    FROM pmc a JOIN pmc b ON a.metric = b.metric AND a.model < b.model""", _MP, extra=_PM_SQL))
def q_compare_models(spark, sf):
    p = _mp(spark, sf)
    pm = M.regression_metrics(p, ["split", "model"], relative=False)
    pm = pm.selectExpr("split", "model", "stack(4, 'mse', mse, 'mae', mae, 'r2', r2, 'rmse', rmse) AS (metric, value)")
    ci = M.bootstrap_ci(p, ["split", "model"], n_boot=_N_BOOT)
    t = pm.join(ci, ["split", "model", "metric"]).withColumn("metric", F.concat_ws("_", "split", "metric", F.lit("avg")))
    return M.compare_models(t.drop("split", "ci_width"))


@register("interpret_metrics", _fx(
    f"""SELECT model, {r6('mse', 'mse')}, {r6('mae', 'mae')}, {r6('bias', 'bias')}, {r6('imp', 'improvement_pct')},
        {r6('ratio', 'mae_ratio_pct')},
        CASE WHEN imp > 80 THEN 'excellent' WHEN imp > 50 THEN 'good' WHEN imp > 20 THEN 'moderate'
             WHEN imp > 0 THEN 'slight' ELSE 'poor' END AS mse_interpretation,
        CASE WHEN ratio < 5 THEN 'excellent' WHEN ratio < 10 THEN 'good' WHEN ratio < 20 THEN 'acceptable'
             WHEN ratio < 50 THEN 'moderate' ELSE 'poor' END AS mae_interpretation,
        CASE WHEN imp > 50 AND ratio < 10 THEN 'excellent' WHEN imp > 30 AND ratio < 20 THEN 'good'
             WHEN imp > 10 AND ratio < 50 THEN 'acceptable' WHEN imp > 0 THEN 'marginal' ELSE 'suboptimal' END
             AS performance_level,
        CASE WHEN mae < 0.1 THEN 'precise' WHEN mae < 0.5 THEN 'production' WHEN mae < 1.0 THEN 'trend'
             ELSE 'rough' END AS practical_significance,
        CASE WHEN bias > 0.05 THEN 'overestimates' WHEN bias < -0.05 THEN 'underestimates' ELSE 'minimal' END
             AS bias_direction
    FROM (SELECT *, CASE WHEN mean_baseline_mse > 0 THEN (mean_baseline_mse - mse) / mean_baseline_mse * 100.0 ELSE 0.0 END AS imp,
                 CASE WHEN target_mean > 0 THEN mae / target_mean * 100.0 ELSE 0.0 END AS ratio FROM (
      SELECT model, avg((y - yhat) ^ 2) AS mse, avg(abs(y - yhat)) AS mae, avg(y - yhat) AS bias,
             (SELECT mse FROM bl WHERE baseline = 'mean') AS mean_baseline_mse,
             (SELECT avg(y) FROM predictions WHERE split = 'train') AS target_mean
      FROM model_predictions WHERE split = 'val' GROUP BY model))""",
    _MP, "predictions", extra=_BASELINE_SQL))
def q_interpret(spark, sf):
    p = _mp(spark, sf).where(F.col("split") == "val")
    base = _baselines(spark, sf).where(F.col("baseline") == "mean").first()["mse"]
    tmean = M.scalar_row(C.predictions(spark, sf).where(F.col("split") == "train").agg(F.avg("y").alias("m")))["m"]
    rows = p.groupBy("model").agg(F.avg((F.col("y") - F.col("yhat")) ** 2).alias("mse"),
                                  F.avg(F.abs(F.col("y") - F.col("yhat"))).alias("mae"),
                                  F.avg(F.col("y") - F.col("yhat")).alias("bias"))
    rows = rows.withColumn("mean_baseline_mse", F.lit(base)).withColumn("target_mean", F.lit(tmean))
    return M.interpret_metrics(rows).drop("mean_baseline_mse", "target_mean")


@register("mse_vs_baselines", _fx(
    f"""SELECT model AS name, 'model' AS kind, {r6('avg((y - yhat) ^ 2)', 'mse')} FROM model_predictions
        WHERE split = 'val' GROUP BY model
        UNION ALL SELECT baseline || '_baseline', 'baseline', {r6('mse')} FROM bl""",
    _MP, "predictions", extra=_BASELINE_SQL))
def q_mse_vs_baselines(spark, sf):
    mm = M.regression_metrics(_mp(spark, sf).where(F.col("split") == "val"), ["model"], relative=False)
    return M.mse_vs_baselines(mm, _baselines(spark, sf))


# ----------------------------------------------------------------------------- folds and cross-validation

from respan.operators import crossval as CV  # noqa: E402
from respan.operators.gram import cross_validate_path, cross_validate_ridge  # noqa: E402
from respan.functions.hashing import sql_hash_hex  # noqa: E402

_K = 5
_FOLD_SQL = f"""
fx AS (SELECT row_id, target AS y, x[1] AS x1 FROM features),
ed AS (SELECT list_distinct(list_filter(quantile_cont(y, [0.2, 0.4, 0.6, 0.8]), lambda e: e > min(y) AND e < max(y))) AS edges FROM fx),
fb AS (SELECT fx.*, CAST(len(list_filter(edges, lambda e: e < y)) AS INTEGER) AS bin FROM fx, ed),
folded AS (SELECT *, CAST((row_number() OVER (PARTITION BY bin ORDER BY {sql_hash_hex('row_id')}, row_id) - 1) % {_K} AS INTEGER) AS fold FROM fb)
"""


def _folded(spark, sf):
    f = C.features(spark, sf).select("row_id", F.col("target").alias("y"), F.element_at("x", 1).alias("x1"))
    return CV.stratified_folds(f, "row_id", "y", _K)


@register("stratified_folds", _fx("SELECT row_id, bin, fold FROM folded", "features", extra=_FOLD_SQL))
def q_folds(spark, sf):
    return _folded(spark, sf).select("row_id", "bin", "fold")


def _cv_sql(model: str, alpha: float = 1.0) -> str:
    if model == "mean":
        params = "SELECT fold, 0.0 AS w, (t_sy - sy) / (t_n - n) AS b FROM s, t"
    else:
        sxx = "((t_sxx - sxx) - (t_sx - sx) * (t_sx - sx) / (t_n - n))"
        sxy = "((t_sxy - sxy) - (t_sx - sx) * (t_sy - sy) / (t_n - n))"
        params = (f"SELECT fold, {sxy} / ({sxx} + {alpha}) AS w, "
                  f"((t_sy - sy) - {sxy} / ({sxx} + {alpha}) * (t_sx - sx)) / (t_n - n) AS b FROM s, t")
    return _FOLD_SQL + f""",
s AS (SELECT fold, count(*) AS n, sum(y) AS sy, sum(x1) AS sx, sum(x1 * x1) AS sxx, sum(x1 * y) AS sxy FROM folded GROUP BY fold),
t AS (SELECT sum(n) AS t_n, sum(sy) AS t_sy, sum(sx) AS t_sx, sum(sxx) AS t_sxx, sum(sxy) AS t_sxy FROM s),
p AS ({params}),
ex AS (SELECT p.fold, CASE WHEN f.fold = p.fold THEN 'test' ELSE 'train' END AS role,
              f.y - ({'p.w * f.x1 + ' if model != 'mean' else ''}p.b) AS err, f.y FROM folded f, p),
sc AS (SELECT fold, role, avg(err * err) AS mse, avg(abs(err)) AS mae,
              CASE WHEN var_pop(y) = 0 THEN CASE WHEN sum(err * err) = 0 THEN 1.0 ELSE 0.0 END
                   ELSE 1 - sum(err * err) / (var_pop(y) * count(*)) END AS r2 FROM ex GROUP BY fold, role),
lg AS (SELECT fold, role, metric, score FROM (UNPIVOT sc ON mse, mae, r2 INTO NAME metric VALUE score)),
fs AS (SELECT fold, metric, max(CASE WHEN role = 'train' THEN score END) AS train_score,
              max(CASE WHEN role = 'test' THEN score END) AS test_score FROM lg GROUP BY fold, metric)
"""


def _cv(spark, sf, model):
    f = _folded(spark, sf)
    return CV.cross_validate(f, _K, "y", None if model == "mean" else "x1", model, alpha=1.0)


@register("cross_validate", _fx(
    f"SELECT 'mean' AS model, fold, metric, {r6('train_score', 'train_score')}, {r6('test_score', 'test_score')} FROM fs",
    "features", extra=_cv_sql("mean")).replace("SELECT 'mean' AS model", "SELECT 'mean' AS model", 1))
def q_cross_validate(spark, sf):
    return _cv(spark, sf, "mean").select(F.lit("mean").alias("model"), "*")


@register("cv_summary", _fx(
    f"""SELECT metric, {r6('avg(test_score)', 'test_mean')}, {r6('stddev_pop(test_score)', 'test_std')},
        {r6('avg(train_score)', 'train_mean')}, {r6('stddev_pop(train_score)', 'train_std')},
        {r6('quantile_cont(test_score, 0.025)', 'test_ci_lower')}, {r6('quantile_cont(test_score, 0.975)', 'test_ci_upper')},
        {r6('avg(train_score) - avg(test_score)', 'generalization_gap')} FROM fs GROUP BY metric""",
    "features", extra=_cv_sql("ridge_1d")))
def q_cv_summary(spark, sf):
    return M.cv_summary(_cv(spark, sf, "ridge_1d"))


_SWEEPS = 60
_LASSO_ALPHAS = [0.3, 0.1, 0.03, 0.01]


def _path_sql(alphas: list[float], kind: str) -> str:
    """Coordinate descent in SQL: step s of the recursion updates feature s % 64 + 1 of every (fold, alpha)."""
    z = "list_inner_product(g.crow, r.w) - g.scale * r.w[g.j]"
    if kind == "lasso":
        new = f"CASE WHEN g.c - ({z}) > r.alpha THEN (g.c - ({z}) - r.alpha) WHEN g.c - ({z}) < -r.alpha THEN (g.c - ({z}) + r.alpha) ELSE 0.0 END / g.scale"
    else:
        new = f"(g.c - ({z})) / (g.scale + r.alpha / g.n)"
    return f"""
fx AS (SELECT row_id, target AS y, CAST(x AS DOUBLE[]) AS x FROM features),
ed AS (SELECT list_distinct(list_filter(quantile_cont(y, [0.2, 0.4, 0.6, 0.8]), lambda e: e > min(y) AND e < max(y))) AS edges FROM fx),
fb AS (SELECT fx.*, CAST(len(list_filter(edges, lambda e: e < y)) AS INTEGER) AS bin FROM fx, ed),
folded AS MATERIALIZED (SELECT row_id, y, x, CAST((row_number() OVER (PARTITION BY bin ORDER BY {sql_hash_hex('row_id')}, row_id) - 1) % {_K} AS INTEGER) AS fold FROM fb),
flat AS (SELECT fold, row_id, y, unnest(x) AS v, generate_subscripts(x, 1) AS j FROM folded),
pairs AS (SELECT a.fold, a.j, b.j AS k, sum(a.v * b.v) AS s FROM flat a JOIN flat b USING (row_id) GROUP BY a.fold, a.j, b.j),
ones AS (SELECT fold, j, count(*) AS n, sum(v) AS sx, sum(y) AS sy, sum(v * y) AS sxy FROM flat GROUP BY fold, j),
tp AS (SELECT j, k, sum(s) AS s FROM pairs GROUP BY j, k),
tone AS (SELECT j, sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxy) AS sxy FROM ones GROUP BY j),
ro AS (SELECT o.fold, o.j, t.n - o.n AS n, t.sx - o.sx AS sx, t.sy - o.sy AS sy, t.sxy - o.sxy AS sxy FROM ones o JOIN tone t USING (j)),
cv AS (SELECT p.fold, p.j, p.k, (t.s - p.s) / a.n - (a.sx / a.n) * (b.sx / b.n) AS c FROM pairs p JOIN tp t ON t.j = p.j AND t.k = p.k
       JOIN ro a ON a.fold = p.fold AND a.j = p.j JOIN ro b ON b.fold = p.fold AND b.j = p.k),
g AS MATERIALIZED (SELECT cv.fold, CAST(cv.j AS INTEGER) AS j, list(cv.c ORDER BY cv.k) AS crow, max(CASE WHEN cv.j = cv.k THEN cv.c END) AS scale,
            max(ro.sxy / ro.n - (ro.sx / ro.n) * (ro.sy / ro.n)) AS c, max(ro.n) AS n
     FROM cv JOIN ro ON ro.fold = cv.fold AND ro.j = cv.j GROUP BY cv.fold, cv.j),
r AS (SELECT fold, alpha, 0 AS step, list_transform(range(64), lambda i: CAST(0 AS DOUBLE)) AS w
      FROM (SELECT DISTINCT fold FROM folded), (SELECT unnest({alphas}::DOUBLE[]) AS alpha)
      UNION ALL
      SELECT r.fold, r.alpha, r.step + 1, list_concat(list_concat(r.w[1:g.j - 1], [CAST({new} AS DOUBLE)]), r.w[g.j + 1:64])
      FROM r JOIN g ON g.fold = r.fold AND g.j = r.step % 64 + 1 WHERE r.step < {64 * _SWEEPS}),
fit AS (SELECT r.fold, r.alpha, r.w, m.my - list_inner_product(m.mx, r.w) AS b
        FROM r JOIN (SELECT fold, list(sx / n ORDER BY j) AS mx, max(sy / n) AS my FROM ro GROUP BY fold) m USING (fold) WHERE step = {64 * _SWEEPS}),
ex AS (SELECT fit.fold, fit.alpha, CASE WHEN f.fold = fit.fold THEN 'test' ELSE 'train' END AS role,
              f.y - list_inner_product(f.x, fit.w) - fit.b AS err, f.y FROM folded f, fit),
sc AS (SELECT fold, alpha, role, avg(err * err) AS mse, avg(abs(err)) AS mae, 1 - sum(err * err) / (var_pop(y) * count(*)) AS r2 FROM ex GROUP BY ALL),
lg AS (SELECT fold, alpha, role, metric, score FROM (UNPIVOT sc ON mse, mae, r2 INTO NAME metric VALUE score)),
fs AS (SELECT fold, alpha, metric, max(CASE WHEN role = 'train' THEN score END) AS train_score,
              max(CASE WHEN role = 'test' THEN score END) AS test_score FROM lg GROUP BY fold, alpha, metric)
"""


def _recursive(sql: str) -> str:
    return sql.replace("WITH", "WITH RECURSIVE", 1)


def _folded_all(spark, sf):
    f = C.features(spark, sf).select("row_id", "x", F.col("target").alias("y"))
    return CV.stratified_folds(f, "row_id", "y", _K)


@register("cross_validate_ridge", _recursive(_fx(
    f"SELECT fold, metric, {r6('train_score', 'train_score')}, {r6('test_score', 'test_score')} FROM fs", "features",
    extra=_path_sql([1.0], "ridge"))))
def q_cv_ridge(spark, sf):
    """M9 with ridge on all features: scores of every fold."""
    return cross_validate_ridge(_folded_all(spark, sf), "x", "y")


@register("cross_validate_lasso", _recursive(_fx(
    f"SELECT fold, alpha, metric, {r6('train_score', 'train_score')}, {r6('test_score', 'test_score')}, true AS optimal FROM fs", "features",
    extra=_path_sql(_LASSO_ALPHAS, "lasso"))))
def q_cv_lasso(spark, sf):
    """M9 with lasso on all features along a path of alphas: scores of every fold, and whether
    every coefficient meets the optimality condition."""
    out = cross_validate_path(_folded_all(spark, sf), "x", "y", _LASSO_ALPHAS)
    return out.select("fold", "alpha", "metric", "train_score", "test_score", (F.col("optimality") < 1e-9).alias("optimal"))
