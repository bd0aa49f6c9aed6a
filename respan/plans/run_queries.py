"""Registered queries: experiment-run analytics, trials and training histories."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from respan import catalog as C
from respan.catalog import with_fixtures
from respan.operators import pruning
from respan.operators import runs as R
from respan.operators import sweeps as SW
from respan.plans.registry import r6, register
from respan.session import stored


def _fx(body: str, *names: str, extra: str = "") -> str:
    if not names:
        return ("WITH " + extra.strip() + "\n" + body) if extra else body
    sql = with_fixtures("", *names)
    if extra:
        sql = sql.rstrip() + ",\n" + extra.strip() + "\n"
    return sql + body


W = "runs_wide"
_START = "strftime(epoch_ms(start_time_ms), '%Y-%m-%d %H:%M:%S')"
_SUMMARY_SQL = f"""
sm AS (SELECT run_id, {_START} AS start_time, coalesce(model, 'unknown') AS model,
              coalesce(embedding, 'unknown') AS embedding, 'summary' AS prediction_mode,
              CASE WHEN model = 'rf' THEN coalesce(n_estimators, '') END AS n_estimators,
              CASE WHEN model IN ('ridge', 'lasso') THEN coalesce(alpha, '') END AS alpha,
              CASE WHEN model = 'torch' THEN coalesce(batch_size, '') END AS batch_size,
              CASE WHEN model = 'torch' THEN coalesce(epochs, '') END AS epochs,
              val_mse_avg, val_mae_avg, val_r2_avg, test_mse_avg, test_mae_avg, test_r2_avg
       FROM (SELECT *, model_type AS model FROM runs_wide))
"""
_SUMMARY_COLS = "run_id, start_time, model, embedding, prediction_mode, n_estimators, alpha, batch_size, epochs"


def _runs(spark, sf):
    return C.runs(spark, sf)


def _summary(spark, sf):
    return R.summary_frame(_runs(spark, sf))


@register("scan_runs", _fx(
    f"SELECT run_id, {r6('val_mse_avg', 'val_mse_avg')} FROM {W} WHERE model_type = 'rf' "
    "ORDER BY val_mse_avg DESC NULLS LAST, run_id", W))
def q_scan_runs(spark, sf):
    return R.scan_runs(_runs(spark, sf), "rf", "val_mse_avg").select("run_id", R.metric("val_mse_avg").alias("val_mse_avg"))


_PARAM_KEYS = ["model_type", "model", "embedding", "prediction_mode", "normalize_targets", "n_estimators",
               "max_depth", "alpha", "C", "kernel", "learning_rate", "batch_size", "epochs"]
_METRIC_KEYS = C.RUN_METRIC_KEYS


@register("log_runs_long", _fx(
    "SELECT run_id, 'param' AS kind, key, svalue, NULL::DOUBLE AS dvalue FROM (UNPIVOT (SELECT run_id, "
    + ", ".join(f"{k}" if k not in ("model", "prediction_mode") else
                ("model_type AS model" if k == "model" else "'summary' AS prediction_mode") for k in _PARAM_KEYS)
    + f" FROM {W}) ON " + ", ".join(_PARAM_KEYS) + " INTO NAME key VALUE svalue) "
    "UNION ALL SELECT run_id, 'metric', key, NULL, " + r6("dvalue") + " FROM (UNPIVOT (SELECT run_id, "
    + ", ".join(_METRIC_KEYS) + f" FROM {W}) ON " + ", ".join(_METRIC_KEYS) + " INTO NAME key VALUE dvalue)", W))
def q_log_runs_long(spark, sf):
    return R.runs_long(_runs(spark, sf))


@register("log_history_long", _fx(
    f"SELECT run_id, 'history' AS kind, key, step, {r6('value', 'dvalue')} FROM metric_history "
    "WHERE value IS NOT NULL AND step % 3 <> 0", "metric_history"))
def q_log_history(spark, sf):
    """History rows for the sink; every third step is made NaN and must be skipped."""
    h = C.metric_history(spark, sf)
    return R.history_long(h.withColumn("value", F.when(F.col("step") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("value"))))


@register("normalize_from_name", _fx(
    f"""SELECT run_id, CASE WHEN normalize_targets IS NULL THEN contains(run_name, 'norm=true')
              WHEN normalize_targets IN ('true', 'True') THEN true WHEN normalize_targets IN ('false', 'False') THEN false END
              AS normalize_targets FROM {W}""", W))
def q_normalize_from_name(spark, sf):
    """P8 with the run-name fallback."""
    return R.normalized_or_named(_runs(spark, sf))


@register("whitelist_linear_runs", _fx(
    f"SELECT run_id, model_type, embedding, {r6('try_cast(alpha AS DOUBLE)', 'alpha')} FROM {W} "
    "WHERE model_type IN ('ridge', 'lasso') AND embedding IS NOT NULL", W))
def q_whitelist_linear(spark, sf):
    """P9 for the linear models."""
    return R.prepare_linear_runs(_runs(spark, sf))


@register("pairwise_metric", _fx(f"SELECT run_id, 'val_mse_avg' AS metric, {r6('val_mse_avg', 'value')} FROM {W} "
                                 "WHERE val_mse_avg IS NOT NULL", W))
def q_pairwise_metric(spark, sf):
    """P11 for comparisons, over the runs that carry the metric."""
    r = _runs(spark, sf)
    return R.pairwise_metric(r.where(R.metric("val_mse_avg").isNotNull()), "val_mse")


@register("experiment_prefix_kinds", _fx(
    f"SELECT run_id, kind, concat_ws('_', model_type, embedding, 'summary') || "
    f"CASE kind WHEN 'arch_opt' THEN '_arch_opt_mlp' ELSE '_' || kind END AS experiment_prefix FROM {W}, "
    "(SELECT unnest(['arch_compare', 'arch_opt', 'hyper_opt']) AS kind)", W))
def q_prefix_kinds(spark, sf):
    """P14 for the three kinds of study."""
    r, out = _runs(spark, sf), None
    for kind in ("arch_compare", "arch_opt", "hyper_opt"):
        one = R.experiment_prefix(r, kind).withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


@register("project_run_params", _fx(f"SELECT {_SUMMARY_COLS} FROM sm", W, extra=_SUMMARY_SQL))
def q_project_run_params(spark, sf):
    return _summary(spark, sf).drop("metrics")


@register("filter_runs", _fx(
    f"SELECT {_SUMMARY_COLS} FROM sm WHERE embedding = 'bert' AND start_time >= '1995-01-01' "
    "AND start_time <= '1996-06-30'", W, extra=_SUMMARY_SQL))
def q_filter_runs(spark, sf):
    return R.filter_runs(_summary(spark, sf), embedding="bert", min_date="1995-01-01",
                         max_date="1996-06-30").drop("metrics")


_NAME_PARTS_SQL = """
parts AS (SELECT run_id, p, i FROM (SELECT run_id, unnest(string_split(run_name, '_')) AS p,
                 generate_subscripts(string_split(run_name, '_'), 1) AS i FROM runs_wide) WHERE contains(p, '=')),
kv AS (SELECT run_id, split_part(p, '=', 1) AS key, substr(p, strpos(p, '=') + 1) AS value, i FROM parts),
parsed AS (SELECT run_id, key, arg_max(value, i) AS value FROM kv GROUP BY run_id, key)
"""


@register("parse_run_name", _fx("SELECT run_id, key, value FROM parsed", W, extra=_NAME_PARTS_SQL))
def q_parse_run_name(spark, sf):
    r = _runs(spark, sf)
    return r.select("run_id", F.explode(R.parse_run_name(F.col("run_name"))).alias("key", "value"))


_FIXED_KEYS = ["n_estimators", "learning_rate"]


@register("fill_params_from_name", _fx(
    """SELECT w.run_id,
         coalesce(w.n_estimators, max(CASE WHEN k.key = 'n_estimators' THEN k.value END)) AS n_estimators,
         coalesce(w.alpha, max(CASE WHEN k.key = 'alpha' THEN k.value END)) AS alpha,
         coalesce(w.C, max(CASE WHEN k.key = 'C' THEN k.value END)) AS C,
         coalesce(w.learning_rate, max(CASE WHEN k.key = 'learning_rate' THEN k.value END)) AS learning_rate
       FROM runs_wide w LEFT JOIN kv2 k ON w.run_id = k.run_id GROUP BY w.run_id, w.n_estimators, w.alpha, w.C, w.learning_rate""",
    W, extra="""
parts2 AS (SELECT run_id, p, i FROM (SELECT run_id,
             unnest(string_split(replace(replace(run_name, 'n_estimators=', 'n' || chr(1) || 'estimators='), 'learning_rate=', 'learning' || chr(1) || 'rate='), '_')) AS p,
             generate_subscripts(string_split(replace(replace(run_name, 'n_estimators=', 'n' || chr(1) || 'estimators='), 'learning_rate=', 'learning' || chr(1) || 'rate='), '_'), 1) AS i
           FROM runs_wide) WHERE contains(p, '=')),
kv2 AS (SELECT run_id, replace(split_part(p, '=', 1), chr(1), '_') AS key, arg_max(substr(p, strpos(p, '=') + 1), i) AS value
        FROM parts2 GROUP BY run_id, key)"""))
def q_fill_params(spark, sf):
    """P6 with the opt-in key list (keys containing '_' parsed whole)."""
    r = _runs(spark, sf).withColumn("_p", R.parse_run_name(F.col("run_name"), keys=_FIXED_KEYS))
    return r.select("run_id", *[F.coalesce(R.param(k), F.col("_p").getItem(k)).alias(k)
                                for k in ["n_estimators", "alpha", "C", "learning_rate"]])


@register("coerce_numeric", _fx(
    f"SELECT run_id, alpha AS alpha_raw, {r6('TRY_CAST(alpha AS DOUBLE)', 'alpha_num')} FROM {W} WHERE alpha IS NOT NULL", W))
def q_coerce_numeric(spark, sf):
    r = _runs(spark, sf).where(R.param("alpha").isNotNull())
    return r.select("run_id", R.param("alpha").alias("alpha_raw"), R.coerce_numeric(R.param("alpha")).alias("alpha_num"))


@register("normalize_bool", _fx(
    "SELECT run_id, normalize_targets AS raw, CASE WHEN normalize_targets IN ('true', 'True') THEN true "
    f"WHEN normalize_targets IN ('false', 'False') THEN false END AS normalize_targets FROM {W}", W))
def q_normalize_bool(spark, sf):
    r = _runs(spark, sf)
    return r.select("run_id", R.param("normalize_targets").alias("raw"),
                    R.normalize_bool(R.param("normalize_targets")).alias("normalize_targets"))


@register("whitelist_runs", _fx(
    """SELECT w.run_id, """ + r6("TRY_CAST(coalesce(w.n_estimators, p1.value) AS DOUBLE)", "n_estimators") + ", "
    + r6("TRY_CAST(coalesce(w.max_depth, p2.value) AS DOUBLE)", "max_depth") + """,
         coalesce(w.embedding, p3.value) AS embedding,
         CASE WHEN w.normalize_targets IN ('true', 'True') THEN true WHEN w.normalize_targets IN ('false', 'False') THEN false END AS normalize_targets
       FROM runs_wide w
       LEFT JOIN parsed p1 ON p1.run_id = w.run_id AND p1.key = 'n_estimators'
       LEFT JOIN parsed p2 ON p2.run_id = w.run_id AND p2.key = 'max_depth'
       LEFT JOIN parsed p3 ON p3.run_id = w.run_id AND p3.key = 'embedding'
       WHERE w.model_type = 'rf' AND coalesce(w.embedding, p3.value) IS NOT NULL
         AND TRY_CAST(coalesce(w.n_estimators, p1.value) AS DOUBLE) IN (5, 10, 20)""", W, extra=_NAME_PARTS_SQL))
def q_whitelist(spark, sf):
    return R.prepare_rf_runs(_runs(spark, sf)).select("run_id", "n_estimators", "max_depth", "embedding",
                                                      "normalize_targets")


@register("detect_target", "SELECT doc_id, toxic, CAST(quality AS DOUBLE) AS target FROM labels")
def q_detect_target(spark, sf):
    """P10: target chosen from the schema of `labels` (first name containing a pattern)."""
    t = C.read_table(spark, sf, "labels")
    target = R.detect_target(t.columns)
    return t.select(*[c for c in t.columns if c != target], F.col(target).cast("double").alias("target"))


@register("metric_lookup", _fx(
    f"SELECT run_id, {r6('coalesce(val_mse_avg, 1e308)', 'objective')} FROM {W}", W))
def q_metric_lookup(spark, sf):
    # +inf is represented by the largest finite stand-in only in this comparison view
    r = _runs(spark, sf).select("run_id", R.metric_lookup("val_mse").alias("objective"))
    return r.withColumn("objective", F.when(F.col("objective") == float("inf"), F.lit(1e308))
                        .otherwise(F.col("objective")))


@register("run_durations", _fx(
    f"SELECT run_id, {_START} AS start_time, {r6('(end_time_ms - start_time_ms) / 60000.0', 'duration_min')} FROM {W}", W))
def q_run_durations(spark, sf):
    return R.run_durations(_runs(spark, sf)).drop("start_ts")


@register("run_label", _fx(f"SELECT run_id, concat_ws(' + ', embedding, model_type) AS run_label FROM {W}", W))
def q_run_label(spark, sf):
    r = _runs(spark, sf)
    return r.select("run_id", R.run_label(R.param("embedding"), R.param("model")).alias("run_label"))


@register("experiment_prefix", _fx(
    """SELECT run_id, concat_ws('_', model_type, embedding, 'summary')
         || coalesce(CASE WHEN model_type = 'torch' THEN '_mlp' END, '')
         || coalesce(CASE WHEN model_type = 'rf' THEN '_n' || n_estimators
                          WHEN model_type IN ('ridge', 'lasso') THEN '_a' || alpha
                          WHEN model_type = 'svm' THEN '_C' || C || '_eps0.1_' || kernel
                          WHEN model_type = 'torch' THEN '_b' || batch_size || '_e' || epochs END, '') AS experiment_prefix
       FROM runs_wide""", W))
def q_experiment_prefix(spark, sf):
    return R.experiment_prefix(_runs(spark, sf))


@register("ordered_param_values", _fx(
    f"""SELECT 'kernel' AS parameter, kernel AS value, CAST(list_position(['linear', 'rbf', 'poly', 'sigmoid'], kernel) AS INTEGER) AS position
        FROM (SELECT DISTINCT kernel FROM {W} WHERE kernel IS NOT NULL)
        UNION ALL
        SELECT 'alpha', CAST(a AS VARCHAR), CAST(dense_rank() OVER (ORDER BY a) AS INTEGER) FROM (
          SELECT DISTINCT TRY_CAST(alpha AS DOUBLE) AS a FROM {W} WHERE TRY_CAST(alpha AS DOUBLE) IS NOT NULL)""", W))
def q_ordered_values(spark, sf):
    r = _runs(spark, sf)
    k = R.ordered_values(r.select(R.param("kernel").alias("value")), "value", R.KERNEL_ORDER)
    a = R.ordered_values(r.select(R.coerce_numeric(R.param("alpha")).alias("a")), "a")
    return (k.select(F.lit("kernel").alias("parameter"), "value", "position")
            .unionByName(a.select(F.lit("alpha").alias("parameter"), F.col("a").cast("string").alias("value"),
                                  F.col("position").cast("int"))))


@register("dedupe_by_embedding", _fx(
    f"SELECT embedding, arg_min(run_id, (start_time_ms, run_id)) AS run_id FROM {W} WHERE embedding IS NOT NULL GROUP BY embedding", W))
def q_dedupe(spark, sf):
    r = _runs(spark, sf).where(R.param("embedding").isNotNull())
    r = r.select(R.param("embedding").alias("embedding"), "run_id", F.struct("start_time_ms", "run_id").alias("o"))
    return R.first_per_key(r, "embedding", "o", ["run_id"])


@register("first_component", _fx(f"SELECT run_id, {r6('coalesce(val_mse_avg, 0.0)', 'first_mse')} FROM {W}", W))
def q_first_component(spark, sf):
    r = _runs(spark, sf)
    return r.select("run_id", R.first_component(F.array(R.metric("val_mse_avg"), R.metric("test_mse_avg")))
                    .alias("first_mse"))


@register("runs_with_metric", _fx(
    f"SELECT run_id, {r6('test_mse_avg', 'test_mse_avg')} FROM {W} WHERE test_mse_avg IS NOT NULL", W))
def q_runs_with_metric(spark, sf):
    return R.runs_with_metric(_runs(spark, sf), "test_mse_avg").select("run_id", "test_mse_avg")


@register("available_embeddings", _fx(
    f"""SELECT e AS embedding, CAST(list_position(['tfidf', 'bert', 'llama'], e) AS INTEGER) AS position
        FROM (SELECT unnest(['tfidf', 'bert', 'llama']) AS e) WHERE e IN (SELECT embedding FROM {W} WHERE status = 'FINISHED')""", W))
def q_available_embeddings(spark, sf):
    r = _runs(spark, sf).where(F.col("status") == "FINISHED").select(R.param("embedding").alias("embedding"))
    declared = r.select(F.explode(F.array(*[F.lit(e) for e in R.EMBEDDING_ORDER])).alias("embedding")).distinct()
    present = declared.join(r, "embedding", "left_semi")
    return present.withColumn("position", F.array_position(
        F.array(*[F.lit(e) for e in R.EMBEDDING_ORDER]), F.col("embedding")).cast("int"))


def _summary_wide(spark, sf):
    s = _summary(spark, sf)
    return s.select("*", *[R.metric(k).alias(k) for k in _METRIC_KEYS]).drop("metrics")


@register("top_runs", _fx(
    f"SELECT run_id, start_time, {r6('val_mse_avg', 'val_mse_avg')} FROM sm ORDER BY val_mse_avg ASC NULLS LAST, run_id LIMIT 10",
    W, extra=_SUMMARY_SQL))
def q_top_runs(spark, sf):
    return R.top_runs(_summary_wide(spark, sf), "val_mse_avg", 10).select("run_id", "start_time", "val_mse_avg")


@register("top_runs_fallback", _fx(
    "SELECT run_id, start_time FROM sm ORDER BY start_time DESC, run_id LIMIT 10", W, extra=_SUMMARY_SQL))
def q_top_runs_fallback(spark, sf):
    """W6 with the summary script's default key val_r2_score, which logged runs never carry."""
    return R.top_runs(_summary_wide(spark, sf), "val_r2_score", 10).select("run_id", "start_time")


@register("latest_run", _fx(
    f"SELECT experiment_id, arg_max(run_id, (start_time_ms, run_id)) AS run_id, max(start_time_ms) AS start_time_ms FROM {W} GROUP BY experiment_id", W))
def q_latest_run(spark, sf):
    return R.latest_run(_runs(spark, sf))


_SETS_METRICS = ["val_mse_avg", "val_r2_avg", "test_mse_avg"]


@register("run_summary_sets", _fx(
    "SELECT model, embedding, count(*) AS count, "
    + ", ".join(r6(f"avg({m})", f"mean_{m}") for m in _SETS_METRICS)
    + ", CAST(grouping(model) AS INTEGER) AS g_model, CAST(grouping(embedding) AS INTEGER) AS g_embedding "
    "FROM sm GROUP BY GROUPING SETS ((model), (embedding), (model, embedding))", W, extra=_SUMMARY_SQL))
def q_summary_sets(spark, sf):
    out = R.summary_sets(_summary_wide(spark, sf), _SETS_METRICS)
    return out.withColumn("g_model", F.col("g_model").cast("int")).withColumn("g_embedding", F.col("g_embedding").cast("int"))


@register("pivot_model_embedding", _fx(
    "SELECT model, " + ", ".join(r6(f"avg(CASE WHEN embedding = '{e}' THEN val_mse_avg END)", e) for e in R.EMBEDDING_ORDER)
    + " FROM sm GROUP BY model", W, extra=_SUMMARY_SQL))
def q_pivot(spark, sf):
    return R.pivot_mean(_summary_wide(spark, sf), "model", "embedding", R.EMBEDDING_ORDER, "val_mse_avg")


_HEAT = ["val_mse_avg", "val_r2_avg", "test_mae_avg"]


@register("metric_heatmap", _fx(
    "SELECT run_label, " + ", ".join(r6(m, m) for m in _HEAT) + ", "
    + ", ".join(r6(f"{'' if 'r2' in m else '1.0 - '}(({m} - min({m}) OVER ()) / nullif(max({m}) OVER () - min({m}) OVER (), 0))",
                   f"norm_{m}") for m in _HEAT)
    + " FROM (SELECT concat_ws(' + ', embedding, model) AS run_label, "
    + ", ".join(f"avg({m}) AS {m}" for m in _HEAT) + " FROM sm GROUP BY 1)", W, extra=_SUMMARY_SQL))
def q_heatmap(spark, sf):
    s = _summary_wide(spark, sf).withColumn("run_label", R.run_label(F.col("embedding"), F.col("model")))
    return R.metric_heatmap(s, "run_label", _HEAT)


_PS_PARAMS = ["n_estimators", "max_depth", "alpha", "C"]
_PS_METRICS = ["val_mse_avg", "test_mse_avg", "val_r2_avg"]
_LONG_SQL = """
lg AS (SELECT * FROM (
  SELECT run_id, embedding,
         CASE WHEN normalize_targets IN ('true', 'True') THEN true WHEN normalize_targets IN ('false', 'False') THEN false END AS normalize_targets,
         parameter, value, metric, metric_value
  FROM (UNPIVOT (UNPIVOT (SELECT run_id, embedding, normalize_targets, n_estimators, max_depth, alpha, C,
                                 val_mse_avg, test_mse_avg, val_r2_avg FROM runs_wide WHERE embedding IS NOT NULL)
                 ON n_estimators, max_depth, alpha, C INTO NAME parameter VALUE value)
        ON val_mse_avg, test_mse_avg, val_r2_avg INTO NAME metric VALUE metric_value)))
"""


def _param_long(spark, sf):
    r = _runs(spark, sf).where(R.param("embedding").isNotNull())
    w = r.select("run_id", R.param("embedding").alias("embedding"),
                 R.normalize_bool(R.param("normalize_targets")).alias("normalize_targets"),
                 *[R.param(p).alias(p) for p in _PS_PARAMS], *[R.metric(m).alias(m) for m in _PS_METRICS])
    return R.unpivot_params_metrics(w, _PS_PARAMS, _PS_METRICS, ["run_id", "embedding", "normalize_targets"])


_PS_GROUPS = ["parameter", "value", "embedding", "normalize_targets", "metric"]


@register("param_summary_stats", _fx(
    f"SELECT {', '.join(_PS_GROUPS)}, {r6('avg(metric_value)', 'mean')}, {r6('median(metric_value)', 'median')}, "
    f"{r6('stddev_samp(metric_value)', 'std')}, {r6('min(metric_value)', 'min')}, {r6('max(metric_value)', 'max')}, "
    f"count(*) AS count FROM lg GROUP BY {', '.join(_PS_GROUPS)}", W, extra=_LONG_SQL))
def q_param_summary(spark, sf):
    return R.param_summary_stats(_param_long(spark, sf), _PS_GROUPS)


@register("param_effect_series", _fx(
    """SELECT parameter, value, metric, """
    + r6("avg(CASE WHEN normalize_targets THEN metric_value END)", "mean_norm") + ", "
    + r6("CASE WHEN count(CASE WHEN normalize_targets THEN metric_value END) > 0 THEN coalesce(stddev_samp(CASE WHEN normalize_targets THEN metric_value END), 0.0) END", "std_norm")
    + ", count(CASE WHEN normalize_targets THEN metric_value END) AS n_norm, "
    + r6("avg(CASE WHEN NOT normalize_targets THEN metric_value END)", "mean_raw") + ", "
    + r6("CASE WHEN count(CASE WHEN NOT normalize_targets THEN metric_value END) > 0 THEN coalesce(stddev_samp(CASE WHEN NOT normalize_targets THEN metric_value END), 0.0) END", "std_raw")
    + ", count(CASE WHEN NOT normalize_targets THEN metric_value END) AS n_raw FROM lg GROUP BY parameter, value, metric",
    W, extra=_LONG_SQL))
def q_param_effect(spark, sf):
    return R.param_effect_series(_param_long(spark, sf), ["parameter", "value", "metric"])


@register("boxplot_stats", _fx(
    "SELECT parameter, value, metric, " + ", ".join([
        r6("min(metric_value)", "min"), r6("quantile_cont(metric_value, 0.25)", "q1"), r6("median(metric_value)", "median"),
        r6("quantile_cont(metric_value, 0.75)", "q3"), r6("max(metric_value)", "max")])
    + ", count(*) AS n, "
    + r6("greatest(min(metric_value), quantile_cont(metric_value, 0.25) - 1.5 * (quantile_cont(metric_value, 0.75) - quantile_cont(metric_value, 0.25)))", "whisker_lo") + ", "
    + r6("least(max(metric_value), quantile_cont(metric_value, 0.75) + 1.5 * (quantile_cont(metric_value, 0.75) - quantile_cont(metric_value, 0.25)))", "whisker_hi")
    + " FROM lg GROUP BY parameter, value, metric", W, extra=_LONG_SQL))
def q_boxplot(spark, sf):
    return R.boxplot_stats(_param_long(spark, sf), ["parameter", "value", "metric"])


@register("boxplot_best", _fx(
    """SELECT parameter, metric,
         CASE WHEN contains(metric, 'r2') THEN arg_max(value, (med, value)) ELSE arg_min(value, (med, value)) END AS best_value,
         CASE WHEN contains(metric, 'r2') THEN arg_min(value, (med, value)) ELSE arg_max(value, (med, value)) END AS worst_value
       FROM (SELECT parameter, value, metric, median(metric_value) AS med FROM lg GROUP BY ALL) GROUP BY parameter, metric""",
    W, extra=_LONG_SQL))
def q_boxplot_best(spark, sf):
    box = R.boxplot_stats(_param_long(spark, sf), ["parameter", "value", "metric"])
    return R.best_worst_by_median(box, ["parameter", "metric"], "value", F.col("metric").contains("r2"))


# ---------------------------------------------------------------- artefacts, grids, sweeps

_ART_SQL = """
art AS (SELECT DISTINCT name FROM (
          SELECT model_type || '_summary_model.pkl' AS name FROM runs_wide
          UNION ALL SELECT embedding_type || '_summary_features_checkpoint.pkl' FROM runs_wide
          UNION ALL SELECT model_type || '-' || status || '.log' FROM runs_wide)),
cat AS (SELECT name, 'model' AS kind, regexp_extract(name, '^(.+?)_(.+?)_model\\.pkl$', 1) AS type,
               regexp_extract(name, '^(.+?)_(.+?)_model\\.pkl$', 2) AS prediction_mode FROM art
        WHERE regexp_matches(name, '^(.+?)_(.+?)_model\\.pkl$')
        UNION ALL
        SELECT name, 'features', regexp_extract(name, '^(.+?)_(.+?)_features_checkpoint\\.pkl$', 1),
               regexp_extract(name, '^(.+?)_(.+?)_features_checkpoint\\.pkl$', 2) FROM art
        WHERE regexp_matches(name, '^(.+?)_(.+?)_features_checkpoint\\.pkl$'))
"""


def _artefacts(spark, sf):
    """Artefact file names as a training run would leave them (one set per run, deduplicated)."""
    r = C._runs_wide_spark(spark, sf)
    names = (r.select(F.concat("model_type", F.lit("_summary_model.pkl")).alias("name"))
             .unionByName(r.select(F.concat("embedding_type", F.lit("_summary_features_checkpoint.pkl")).alias("name")))
             .unionByName(r.select(F.concat("model_type", F.lit("-"), "status", F.lit(".log")).alias("name"))))
    return names.distinct()


def _catalogue(spark, sf):
    from respan.sources.files import artefact_catalogue
    return artefact_catalogue(_artefacts(spark, sf))


@register("artefact_catalogue", _fx("SELECT name, kind, type, prediction_mode FROM cat", W, extra=_ART_SQL))
def q_artefact_catalogue(spark, sf):
    return _catalogue(spark, sf)


@register("pair_artefacts", _fx(
    "SELECT m.type AS model_type, f.type AS embedding, m.prediction_mode FROM cat m JOIN cat f "
    "ON m.prediction_mode = f.prediction_mode AND m.kind = 'model' AND f.kind = 'features'", W, extra=_ART_SQL))
def q_pair_artefacts(spark, sf):
    """Model x feature artefacts of the same prediction mode.  The catalogue holds one
    row per distinct artefact name (a model-type or embedding dimension), not per run."""
    c = _catalogue(spark, sf)
    m = c.where(F.col("kind") == "model").select(F.col("type").alias("model_type"), "prediction_mode")
    f = c.where(F.col("kind") == "features").select(F.col("type").alias("embedding"), "prediction_mode")
    return m.join(f, "prediction_mode").select("model_type", "embedding", "prediction_mode")


@register("pairs_by_mode", _fx(
    "SELECT prediction_mode, string_agg(name, ',' ORDER BY name) AS names, count(*) AS n FROM cat GROUP BY prediction_mode",
    W, extra=_ART_SQL))
def q_pairs_by_mode(spark, sf):
    return R.pairs_by_mode(_catalogue(spark, sf))


_GRID_SQL = """
SELECT mode, embedding, model FROM
  (SELECT DISTINCT 'summary' AS mode FROM runs_wide),
  (SELECT DISTINCT embedding_type AS embedding FROM runs_wide),
  (SELECT DISTINCT model_type AS model FROM runs_wide)
WHERE NOT (model = 'torch' AND embedding = 'tfidf')
"""


@register("experiment_grid", _fx(_GRID_SQL, W))
def q_grid(spark, sf):
    """Modes x embeddings x models present in the run log, minus torch+tfidf; the
    dimension value lists are collected as arrays in one aggregate row and exploded."""
    r = _runs(spark, sf)
    dims = r.agg(F.collect_set(R.param("prediction_mode")).alias("mode"),
                 F.collect_set(R.param("embedding")).alias("embedding"),
                 F.collect_set(R.param("model")).alias("model"))
    g = R.grid_from_dimensions(dims, ["mode", "embedding", "model"])
    return g.where(~((F.col("model") == "torch") & (F.col("embedding") == "tfidf")))


@register("sweep_plan", _fx(
    """SELECT parameter, value, CAST(run AS INTEGER) AS run FROM (
         SELECT DISTINCT parameter, value FROM (UNPIVOT (SELECT n_estimators, alpha, C, learning_rate FROM runs_wide)
                ON n_estimators, alpha, C, learning_rate INTO NAME parameter VALUE value)),
         range(1, 4) t(run)""", W))
def q_sweep_plan(spark, sf):
    """Every distinct (swept parameter, value) repeated n_runs = 3 times."""
    r = _runs(spark, sf)
    keys = ["n_estimators", "alpha", "C", "learning_rate"]
    vals = r.selectExpr(f"stack({len(keys)}, " + ", ".join(f"'{k}', params['{k}']" for k in keys) + ") AS (parameter, value)")
    vals = vals.where(F.col("value").isNotNull()).distinct()
    return vals.select("parameter", "value", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("run"))


_SWEPT = ["n_estimators", "max_depth", "alpha", "C", "kernel", "learning_rate", "batch_size", "epochs", "embedding", "model", "normalize_targets"]
_VALUES_SQL = """
vals AS (SELECT DISTINCT model_type AS model, parameter, value FROM (UNPIVOT (SELECT model_type, """ + ", ".join(
    f"{c} AS {c}" if c != "model" else "model_type AS model" for c in _SWEPT) + """ FROM runs_wide) ON """ + ", ".join(_SWEPT) + """
         INTO NAME parameter VALUE value))
"""


def _values_list(rows) -> str:
    return ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in r) + ")" for r in rows)


_SWEEP_SQL = _VALUES_SQL.rstrip() + f""",
mem(parent, child) AS (VALUES {_values_list([(s, m) for s, ms in SW.SETS.items() for m in ms])}),
reach AS (SELECT parent AS root, child AS name FROM mem UNION SELECT reach.root, mem.child FROM reach JOIN mem ON mem.parent = reach.name),
sw(name, parameter, base) AS (VALUES {_values_list([(s, p, m or SW.BASELINE['model']) for s, (p, m) in SW.SWEEPS.items()])}),
os AS (SELECT root, sw.* FROM (SELECT * FROM reach UNION SELECT name, name FROM sw) r JOIN sw USING (name)),
sv AS (SELECT DISTINCT sw.name, vals.value FROM sw JOIN vals ON vals.parameter = sw.parameter
       AND (vals.model = sw.base OR sw.parameter IN ('model', 'embedding', 'normalize_targets'))),
pos AS (SELECT name, value, row_number() OVER (PARTITION BY name ORDER BY try_cast(value AS DOUBLE) NULLS LAST, value) AS position FROM sv),
al AS (SELECT root, name, parameter, base, CAST(NULL AS VARCHAR) AS value, 0 AS position FROM os
       UNION ALL SELECT root, os.name, parameter, base, pos.value, pos.position FROM os JOIN pos USING (name))
"""


@register("sweep_sets", _fx(
    f"""SELECT root, name AS sweep, CAST(position AS INTEGER) AS position, CASE WHEN value IS NOT NULL THEN parameter END AS parameter, value, model,
           CAST(run AS INTEGER) AS run, what || '_model=' || model || '_emb=' || emb || '_norm=' || norm || '_run' || run AS experiment_name,
           CASE WHEN what LIKE 'C=%' THEN value WHEN model = 'svm' THEN '{SW.BASELINE['C']}' END AS config_c
        FROM (SELECT *, CASE WHEN value IS NOT NULL AND parameter = 'model' THEN value ELSE base END AS model,
                     CASE WHEN value IS NOT NULL AND parameter = 'embedding' THEN value ELSE 'tfidf' END AS emb,
                     CASE WHEN value IS NOT NULL AND parameter = 'normalize_targets' THEN value ELSE 'false' END AS norm,
                     CASE WHEN value IS NULL THEN 'baseline' ELSE parameter || '=' || value END AS what FROM al), range(1, 4) t(run)""",
    W, extra=_SWEEP_SQL).replace("WITH", "WITH RECURSIVE", 1))
def q_sweep_sets(spark, sf):
    """All named sets and the sweeps that they reach, values per model from the run log."""
    out = SW.sweep_runs(spark, SW.values_by_model(_runs(spark, sf), _SWEPT))
    return out.select("root", "sweep", "position", "parameter", "value", "model", "run", "experiment_name", F.col("config")["C"].alias("config_c"))


@register("experiment_grid_values", _fx(
    """SELECT g.mode, g.embedding, g.model, v.parameter, v.value FROM (SELECT 'summary' AS mode, embedding, model FROM
         (SELECT DISTINCT embedding_type AS embedding FROM runs_wide), (SELECT DISTINCT model_type AS model FROM runs_wide)) g
       JOIN (SELECT * FROM vals WHERE parameter NOT IN ('model', 'embedding', 'normalize_targets')
             UNION ALL SELECT DISTINCT model, NULL, NULL FROM vals) v ON v.model = g.model
       WHERE NOT (g.model = 'torch' AND g.embedding = 'tfidf')""", W, extra=_VALUES_SQL))
def q_grid_values(spark, sf):
    """J7 with the values of each model: distinct values of each dimension first, then the grid."""
    values = SW.values_by_model(_runs(spark, sf), [*_SWEPT, "prediction_mode"])
    values = stored(values, "grid-values")  # a few rows, read for the dimensions and for the grid
    dims = values.select("parameter", "value").distinct().groupBy().pivot("parameter", ["prediction_mode", "embedding", "model"]).agg(
        F.collect_list("value")).withColumnRenamed("prediction_mode", "mode")
    g = SW.grid_with_values(dims, values.where("parameter <> 'prediction_mode'"), ["mode", "embedding", "model"])
    return g.where(~((F.col("model") == "torch") & (F.col("embedding") == "tfidf")))


# ---------------------------------------------------------------- baselines beside run statistics


@register("attach_baseline", _fx(
    """SELECT s.embedding, s.metric, s.normalize_targets, """ + r6("s.mean", "mean") + ", " + r6("b.baseline", "baseline") + """
       FROM (SELECT embedding, metric, normalize_targets, avg(metric_value) AS mean FROM lg
             WHERE normalize_targets IS NOT NULL GROUP BY ALL) s
       JOIN (VALUES ('test_mse_avg', true, 1.506065), ('test_r2_avg', true, -0.000354), ('val_mse_avg', true, 0.292405),
                    ('val_r2_avg', true, -0.006406), ('test_mse_avg', false, 44.160929), ('test_r2_avg', false, -0.000354),
                    ('val_mse_avg', false, 8.573906), ('val_r2_avg', false, -0.006406)) b(metric, normalized, baseline)
       ON s.metric = b.metric AND s.normalize_targets = b.normalized""", W, extra=_LONG_SQL))
def q_attach_baseline(spark, sf):
    from respan.operators.baselines import attach_baseline
    lg = _param_long(spark, sf).where(F.col("normalize_targets").isNotNull())
    s = lg.groupBy("embedding", "metric", "normalize_targets").agg(F.avg("metric_value").alias("mean"))
    return attach_baseline(spark, s).select("embedding", "metric", "normalize_targets", "mean", "baseline")


# ---------------------------------------------------------------- trials and training histories

_TRIAL_PARAMS = ["n_estimators", "max_depth"]


def _trials(spark, sf):
    t = C.trials(spark, sf)
    return t.select("study", "number", "state", "value", *[t.params[p].alias(p) for p in _TRIAL_PARAMS])


@register("best_so_far", _fx(
    f"SELECT study, number, {r6('min(value) OVER (PARTITION BY study ORDER BY number RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)', 'best_so_far')} FROM trials",
    "trials"))
def q_best_so_far(spark, sf):
    return R.best_so_far(_trials(spark, sf))


@register("best_trial", _fx(
    f"SELECT study, arg_min(number, (coalesce(value, 'inf'::DOUBLE), number)) AS best_number, "
    f"{r6('min(coalesce(value, 1e308))', 'best_objective')}, "
    "arg_min(n_estimators, (coalesce(value, 'inf'::DOUBLE), number)) AS n_estimators, "
    "arg_min(max_depth, (coalesce(value, 'inf'::DOUBLE), number)) AS max_depth FROM trials GROUP BY study", "trials"))
def q_best_trial(spark, sf):
    b = R.best_trial(_trials(spark, sf), _TRIAL_PARAMS)
    return b.withColumn("best_objective", F.when(F.col("best_objective") == float("inf"), 1e308)
                        .otherwise(F.col("best_objective")))


@register("study_history", _fx(
    f"SELECT study, count(*) AS n_complete, {r6('min(value)', 'best_value')}, arg_min(number, (value, number)) AS best_number "
    "FROM trials WHERE state = 'COMPLETE' GROUP BY study", "trials"))
def q_study_history(spark, sf):
    return R.study_history(_trials(spark, sf))


@register("param_importance", _fx(
    """SELECT t.study, l.param, """ + r6("sum(l.c * (l.m - t.mu) ^ 2) / (first(t.n) * first(t.v))", "importance") + """
       FROM (SELECT study, param, pvalue, avg(value) AS m, count(value) AS c FROM (
               UNPIVOT (SELECT study, value, n_estimators, max_depth FROM trials) ON n_estimators, max_depth
               INTO NAME param VALUE pvalue) GROUP BY ALL) l
       JOIN (SELECT study, avg(value) AS mu, var_pop(value) AS v, count(value) AS n FROM trials GROUP BY study) t
       ON l.study = t.study GROUP BY t.study, l.param""", "trials"))
def q_param_importance(spark, sf):
    return R.param_importance(_trials(spark, sf), _TRIAL_PARAMS)


@register("early_stop_epoch", _fx(
    """SELECT run_id, """ + r6("min(value)", "best_value") + """, arg_min(step, (value, step)) AS best_epoch,
         CAST(min(CASE WHEN since >= 2 THEN step END) AS DOUBLE) AS stop_epoch, max(step) AS last_epoch
       FROM (SELECT *, seen - max(CASE WHEN improved THEN seen END) OVER (PARTITION BY run_id ORDER BY step
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS since
             FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY step) AS seen, (min(value) OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) IS NULL
                             OR value < min(value) OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS improved
                   FROM metric_history WHERE key = 'val_loss'))
       GROUP BY run_id""", "metric_history"))
def q_early_stop(spark, sf):
    out = R.early_stop(C.metric_history(spark, sf), "val_loss", patience=2)
    return out.withColumn("stop_epoch", F.col("stop_epoch").cast("double"))


_PRUNE_VALUES_SQL = """
iv AS (SELECT 's' || CAST(l_orderkey % 8 AS VARCHAR) AS study, l_orderkey // 8 AS number, l_linenumber AS step,
              l_extendedprice / 1000.0 AS value FROM lineitem)
"""


def _intermediate_values(spark, sf):
    li = C.read_table(spark, sf, "lineitem")
    return li.select(F.concat(F.lit("s"), (F.col("l_orderkey") % 8).cast("string")).alias("study"),
                     F.expr("l_orderkey div 8").alias("number"), F.col("l_linenumber").alias("step"),
                     (F.col("l_extendedprice") / 1000.0).alias("value"))


@register("median_prune", _fx(
    """SELECT study, number, CAST(min(CASE WHEN n_before >= 10 AND step >= 0 AND value > med THEN step END) AS DOUBLE) AS prune_step,
              max(step) AS last_step
       FROM (SELECT *, median(value) OVER w AS med, count(value) OVER w AS n_before FROM iv
             WINDOW w AS (PARTITION BY study, step ORDER BY number RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
       GROUP BY study, number""", extra=_PRUNE_VALUES_SQL))
def q_median_prune(spark, sf):
    out = pruning.median_prune(_intermediate_values(spark, sf), n_startup=10, n_warmup=0)
    # nullable integers compare as doubles (pandas turns them into floats on one side)
    return out.withColumn("prune_step", F.col("prune_step").cast("double"))


@register("comparison_table", _fx(
    """SELECT model_type AS model, count(*) AS n_runs, count(*) FILTER (WHERE status = 'FAILED') AS n_errors,
         """ + r6("avg(coalesce(test_mse_avg, NULL))", "mean_test_mse") + ", " + r6("avg(test_r2_avg)", "mean_test_r2") + ", "
    + r6("avg((end_time_ms - start_time_ms) / 1000.0)", "mean_seconds") + f" FROM {W} GROUP BY model_type", W))
def q_comparison_table(spark, sf):
    from respan.operators.search import comparison_table
    return comparison_table(_runs(spark, sf))


@register("first_n_files", _fx("SELECT base_name FROM dsl_docs", "dsl_docs"))
def q_first_n(spark, sf):
    """W14 without its input cap: all documents by name."""
    return C.dsl_docs(spark, sf).select("base_name").orderBy("base_name")


_LOG_SQL = """
lg AS (SELECT l_orderkey % 500 AS log, l_orderkey AS run, l_linenumber AS step, l_partkey AS part, l_suppkey AS supp,
              (['train_loss', 'val_loss', 'learning_rate'])[l_partkey % 3 + 1] || ' of run ' || l_orderkey || ': ' ||
              CAST(round(l_extendedprice * 1000) AS BIGINT) AS line,
              l_shipdate AS day FROM lineitem),
ls AS (SELECT *, row_number() OVER (PARTITION BY log ORDER BY run, step, part, supp, line) AS pos FROM lg)
"""


@register("scrape_log_metrics", _fx(
    """SELECT 'run_' || l.log || '.log' AS file, k.key, CASE WHEN l.log % 7 = 0 THEN 'N/A' ELSE coalesce(s.value, 'N/A') END AS value
       FROM (SELECT DISTINCT log FROM ls) l CROSS JOIN (SELECT unnest(['val_loss', 'train_loss', 'val_r2']) AS key) k
       LEFT JOIN (SELECT log, key, arg_max(regexp_extract(line, '.*: (.*)$', 1), pos) AS value FROM
                  (SELECT ls.*, unnest(['val_loss', 'train_loss', 'val_r2']) AS key FROM ls) WHERE contains(line, key) GROUP BY ALL) s
       ON s.log = l.log AND s.key = k.key""", extra=_LOG_SQL))
def q_scrape(spark, sf):
    """Log files are written, then every log is read from its end; logs of failed runs give N/A."""
    from respan.session import scratch_path
    from respan.sources.files import scan_log_metrics, write_text_files
    li = C.read_table(spark, sf, "lineitem")
    line = F.concat(F.element_at(F.array(*[F.lit(k) for k in ("train_loss", "val_loss", "learning_rate")]), (F.col("l_partkey") % 3 + 1).cast("int")),
                    F.lit(" of run "), F.col("l_orderkey").cast("string"), F.lit(": "),
                    F.round(F.col("l_extendedprice") * 1000).cast("bigint").cast("string"))
    logs = li.select(F.concat(F.lit("run_"), (F.col("l_orderkey") % 500).cast("string"), F.lit(".log")).alias("file"), "l_orderkey",
                     "l_linenumber", "l_partkey", "l_suppkey", line.alias("line"))
    folder = scratch_path(spark, f"logs-{uuid.uuid4().hex}")
    write_text_files(logs, folder, "file", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "line"], "line")
    failed = logs.select("file").distinct().where(F.regexp_extract("file", r"(\d+)", 1).cast("int") % 7 == 0)
    return scan_log_metrics(spark, folder, ["val_loss", "train_loss", "val_r2"], failed=failed).drop("offset")

