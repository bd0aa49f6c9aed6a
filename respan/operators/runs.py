"""Experiment-run analytics.

A run log is one row per run with MAP<STRING,STRING> params and MAP<STRING,DOUBLE>
metrics (fixed schema however many distinct keys exist).  The reference builds a
wide pandas frame with one column per key and loops over parameters, metrics and
embeddings re-filtering the frame each time; here every such table is one grouped
aggregate over an unpivoted (exploded) form, so adding parameters or metrics adds
rows, not jobs.  For pushdown, keep frequently filtered keys (model type) as real
columns or partition columns of the stored run table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values (must equal the reference's constants)
MODEL_PARAMS = {"rf": ["n_estimators"], "ridge": ["alpha"], "lasso": ["alpha"], "torch": ["batch_size", "epochs"]}
TRUE_STRINGS = ["true", "True"]
FALSE_STRINGS = ["false", "False"]
VALID_N_ESTIMATORS = [5, 10, 20]
KERNEL_ORDER = ["linear", "rbf", "poly", "sigmoid"]
GAMMA_ORDER = ["scale", "auto"]
MODEL_ORDER = ["rf", "ridge", "lasso", "svm", "torch"]
EMBEDDING_ORDER = ["tfidf", "bert", "llama"]
#: Trial numbers of one block of the running best.
BLOCK = 4096
TOP_SORT_FALLBACK = ["val_mse", "val_mae", "val_r2_score", "start_time"]
TARGET_PATTERNS = ("response_time", "response", "time", "latency", "duration", "y", "target", "label", "output")
START_FMT = "yyyy-MM-dd HH:mm:ss"


def param(key: str) -> Column:
    return F.col("params").getItem(key)


def metric(key: str) -> Column:
    return F.col("metrics").getItem(key)


def start_time_str(col: str = "start_time_ms") -> Column:
    return F.date_format(F.timestamp_millis(F.col(col)), START_FMT)


def scan_runs(runs: DataFrame, model_type: str | None = None, order_metric: str | None = None,
              max_results: int | None = None) -> DataFrame:
    """All runs (optionally of one model type), ordered by a metric descending;
    ``max_results`` asks for the first so many only."""
    df = runs
    if model_type is not None:
        df = df.where(param("model_type") == model_type)
    if order_metric is not None:
        df = df.orderBy(metric(order_metric).desc_nulls_last(), F.col("run_id"))
    return df if max_results is None else df.limit(max_results)


def runs_long(runs: DataFrame) -> DataFrame:
    """Params and metrics as long (run_id, kind, key, svalue, dvalue) rows for logging
    sinks: a param has its string, a metric its number."""
    p = runs.select("run_id", F.lit("param").alias("kind"), F.explode("params").alias("key", "svalue"),
                    ).withColumn("dvalue", F.lit(None).cast("double"))
    m = runs.select("run_id", F.lit("metric").alias("kind"), F.explode("metrics").alias("key", "dvalue"))
    return p.unionByName(m.withColumn("svalue", F.lit(None).cast("string")))


def history_long(history: DataFrame) -> DataFrame:
    """Per-epoch history rows for the sink; values that are null or NaN are not logged."""
    return (history.where(F.col("value").isNotNull() & ~F.isnan("value"))
            .select("run_id", F.lit("history").alias("kind"), "key", "step", F.col("value").alias("dvalue")))


def interval_long(intervals: DataFrame) -> DataFrame:
    """Confidence intervals (metric_name, model, ci_lower, ci_upper) as three metric rows."""
    return intervals.selectExpr("model", "stack(3, concat(metric_name, '_ci_lower'), ci_lower, concat(metric_name, '_ci_upper'), "
                                "ci_upper, concat(metric_name, '_ci_width'), ci_upper - ci_lower) AS (key, dvalue)")


def summary_frame(runs: DataFrame) -> DataFrame:
    """P4 + P12: the reference's run summary row: start time string, model/embedding/mode
    defaulting to 'unknown', model-specific hyper-parameters ('' when missing)."""
    model = F.coalesce(param("model"), F.lit("unknown"))
    return runs.select(
        "run_id", start_time_str().alias("start_time"), model.alias("model"),
        F.coalesce(param("embedding"), F.lit("unknown")).alias("embedding"),
        F.coalesce(param("prediction_mode"), F.lit("unknown")).alias("prediction_mode"),
        F.when(model == "rf", F.coalesce(param("n_estimators"), F.lit(""))).alias("n_estimators"),
        F.when(model.isin("ridge", "lasso"), F.coalesce(param("alpha"), F.lit(""))).alias("alpha"),
        F.when(model == "torch", F.coalesce(param("batch_size"), F.lit(""))).alias("batch_size"),
        F.when(model == "torch", F.coalesce(param("epochs"), F.lit(""))).alias("epochs"),
        "metrics")


def filter_runs(summary: DataFrame, model: str | None = None, embedding: str | None = None,
                min_date: str | None = None, max_date: str | None = None) -> DataFrame:
    """Equality filters and *string* comparison of the formatted start time, so a
    bare max date like '2024-01-05' excludes runs later on that day."""
    df = summary
    if model:
        df = df.where(F.col("model") == model)
    if embedding:
        df = df.where(F.col("embedding") == embedding)
    if min_date:
        df = df.where(F.col("start_time") >= F.lit(min_date))
    if max_date:
        df = df.where(F.col("start_time") <= F.lit(max_date))
    return df


def parse_run_name(name: Column, keys: Sequence[str] | None = None) -> Column:
    """P5: MAP of ``key=value`` parts of a run name split on '_' (last duplicate wins).

    Default keeps the reference behaviour (a key containing '_' is cut to its last
    piece, e.g. learning_rate=0.1 -> rate); ``keys`` lists keys to recognise whole."""
    if keys:
        # protect listed keys: replace their '_' before splitting, restore after
        protected = name
        for k in keys:
            if "_" in k:
                protected = F.regexp_replace(protected, k + "=", k.replace("_", "\u0001") + "=")
        name = protected
    parts = F.filter(F.split(name, "_"), lambda p: p.contains("="))
    entries = F.transform(parts, lambda p: F.struct(
        F.regexp_replace(F.substring_index(p, "=", 1), "\u0001", "_").alias("key"),
        F.regexp_extract(p, "^[^=]*=(.*)$", 1).alias("value")))
    # last duplicate wins: keep an entry only if its key does not occur later
    idx = F.transform(entries, lambda e, i: F.struct(e["key"].alias("key"), e["value"].alias("value"),
                                                      i.alias("i")))
    last = F.filter(idx, lambda e: ~F.exists(idx, lambda o: (o["key"] == e["key"]) & (o["i"] > e["i"])))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"], e["value"])))


def coerce_numeric(c: Column) -> Column:
    """Unparsable strings become null (ANSI-safe)."""
    return c.try_cast("double")


def normalize_bool(c: Column) -> Column:
    """Only true/True and false/False map; anything else is null."""

    return F.when(c.isin(*TRUE_STRINGS), F.lit(True)).when(c.isin(*FALSE_STRINGS), F.lit(False))


def normalized_or_named(runs: DataFrame) -> DataFrame:
    """P8 with its fallback: ``normalize_targets`` of the params; where it is absent, true if the
    run name says ``norm=true``, else false."""
    named = F.col("run_name").contains("norm=true")
    flag = F.when(param("normalize_targets").isNull(), F.coalesce(named, F.lit(False))).otherwise(
        normalize_bool(param("normalize_targets")))
    return runs.select("run_id", flag.alias("normalize_targets"))


def prepare_linear_runs(runs: DataFrame) -> DataFrame:
    """P9 for linear models: ridge and lasso runs with an embedding; alpha as a number."""
    return (runs.where(param("model_type").isin("ridge", "lasso") & param("embedding").isNotNull())
            .select("run_id", param("model_type").alias("model_type"), param("embedding").alias("embedding"),
                    coerce_numeric(param("alpha")).alias("alpha")))


def prepare_rf_runs(runs: DataFrame) -> DataFrame:
    """P5-P9 as in the forest figure script: rf runs only, params filled from the run
    name when missing (keys n_estimators, max_depth, embedding, normalize; names carry
    emb/norm, so those two are never filled - kept), numeric coercion, boolean
    normalisation, essential embedding present, n_estimators in {5, 10, 20}."""
    df = runs.where(param("model_type") == "rf")
    parsed = parse_run_name(F.col("run_name"))
    df = df.withColumn("_parsed", parsed)
    cols = {}
    for k in ["n_estimators", "max_depth", "embedding", "normalize"]:
        cols[k] = F.coalesce(param(k), F.col("_parsed").getItem(k))
    df = df.select(
        "run_id", "run_name", "metrics",
        coerce_numeric(cols["n_estimators"]).alias("n_estimators"),
        coerce_numeric(cols["max_depth"]).alias("max_depth"),
        cols["embedding"].alias("embedding"),
        normalize_bool(param("normalize_targets")).alias("normalize_targets"))
    return df.where(F.col("embedding").isNotNull() & F.col("n_estimators").isin(*VALID_N_ESTIMATORS))


def detect_target(columns: Sequence[str], patterns: Sequence[str] = TARGET_PATTERNS) -> str:
    """P10 (schema-time): first column whose lower-case name contains a pattern, else the last."""
    for c in columns:
        if any(p in c.lower() for p in patterns):
            return c
    return columns[-1]


def feature_columns(columns: Sequence[str], patterns: Sequence[str] = TARGET_PATTERNS) -> list[str]:
    """P10: the columns that are features - none whose name contains a target pattern (they
    would leak the target), and not the target."""
    target = detect_target(columns, patterns)
    return [c for c in columns if c != target and not any(p in c.lower() for p in patterns)]


def metric_lookup(name: str) -> Column:
    """``m``, else ``m_avg``, else +inf."""
    return F.coalesce(metric(name), metric(name + "_avg"), F.lit(float("inf")))


def pairwise_metric(runs: DataFrame, name: str, suffixes: Sequence[str] = ("_avg", "_min", "_max")) -> DataFrame:
    """P11 for comparisons: the first suffix whose metric every run carries (else none):
    (run_id, metric, value); one aggregate decides."""
    row = runs.agg(*[(F.count(metric(name + s)) == F.count(F.lit(1))).alias(s) for s in suffixes]).first()
    chosen = next((name + s for s in suffixes if row[s]), None)
    out = runs if chosen else runs.where(F.lit(False))
    return out.select("run_id", F.lit(chosen or name).alias("metric"), metric(chosen or name).alias("value"))


def run_durations(runs: DataFrame) -> DataFrame:
    """Epoch-ms to timestamp, formatted string and duration in minutes (null end stays null)."""
    return runs.select("run_id", F.timestamp_millis("start_time_ms").alias("start_ts"),
                       start_time_str().alias("start_time"),
                       ((F.col("end_time_ms") - F.col("start_time_ms")) / 60000.0).alias("duration_min"))


def run_label(embedding: Column, model: Column) -> Column:
    """Compound label 'embedding + model'."""
    return F.concat_ws(" + ", embedding, model)


def experiment_prefix(runs: DataFrame, kind: str | None = None) -> DataFrame:
    """Deterministic part of the experiment id: model_embedding_mode plus the suffix of a
    kind of study (``arch_compare``, ``arch_opt_<architecture>``, ``hyper_opt``), else the
    model-specific key parameters (the timestamp and uuid are appended at run time)."""
    m = param("model")
    base = F.concat_ws("_", m, param("embedding"), param("prediction_mode"))
    torch_arch = F.when(m == "torch", F.concat(F.lit("_"), F.coalesce(param("architecture"), F.lit("mlp"))))
    extra = (F.when(m == "rf", F.concat(F.lit("_n"), param("n_estimators")))
             .when(m.isin("ridge", "lasso"), F.concat(F.lit("_a"), param("alpha")))
             .when(m == "svm", F.concat(F.lit("_C"), param("C"), F.lit("_eps"), F.coalesce(param("epsilon"), F.lit("0.1")),
                                        F.lit("_"), param("kernel")))
             .when(m == "torch", F.concat(F.lit("_b"), param("batch_size"), F.lit("_e"), param("epochs"))))
    if kind is not None:
        tail = F.concat(F.lit("_arch_opt_"), F.coalesce(param("architecture"), F.lit("mlp"))) if kind == "arch_opt" \
            else F.lit(f"_{kind}")
        return runs.select("run_id", F.concat(base, tail).alias("experiment_prefix"))
    return runs.select("run_id", F.concat(base, F.coalesce(torch_arch, F.lit("")), F.coalesce(extra, F.lit("")))
                       .alias("experiment_prefix"))


def ordered_values(df: DataFrame, col: str, order: Sequence[str] | None = None) -> DataFrame:
    """Distinct non-null values; numeric order, or a declared category order with
    unknown values dropped."""
    d = df.select(col).where(F.col(col).isNotNull()).distinct()
    if order is None:
        return d.withColumn("position", F.dense_rank().over(Window.orderBy(F.col(col).try_cast("double"))))
    pos = F.array_position(F.array(*[F.lit(v) for v in order]), F.col(col))
    return d.withColumn("position", pos.cast("int")).where(F.col("position") > 0)


def first_per_key(df: DataFrame, key: str, order_col: str, value_cols: Sequence[str]) -> DataFrame:
    """First-seen row per key (``min_by`` on an explicit order column)."""
    return df.groupBy(key).agg(*[F.min_by(c, order_col).alias(c) for c in value_cols])


def first_component(c: Column) -> Column:
    """First element of a list-valued metric, 0 when absent."""
    return F.coalesce(F.get(c, 0), F.lit(0.0))


def runs_with_metric(df: DataFrame, m: str) -> DataFrame:
    """Runs carrying metric ``m``, ascending by it."""
    return df.where(metric(m).isNotNull()).withColumn(m, metric(m)).orderBy(F.col(m).asc(), F.col("run_id"))


def top_runs(summary_wide: DataFrame, sort: str, n: int = 10) -> DataFrame:
    """Top-n runs by ``sort`` (ascending when the name contains mse/mae), falling
    back through val_mse, val_mae, val_r2_score, start_time (chosen from the schema)."""
    col = sort if sort in summary_wide.columns else next(
        (c for c in TOP_SORT_FALLBACK if c in summary_wide.columns), None)
    if col is None:
        return summary_wide.limit(n)
    asc = "mse" in col or "mae" in col
    o = F.col(col).asc_nulls_last() if asc else F.col(col).desc_nulls_last()
    return summary_wide.orderBy(o, F.col("run_id")).limit(n)


def latest_run(runs: DataFrame, by: str = "experiment_id") -> DataFrame:
    """Most recent run per group (max_by on start time; ties broken by run id)."""
    return runs.groupBy(by).agg(
        F.max_by("run_id", F.struct("start_time_ms", "run_id")).alias("run_id"),
        F.max("start_time_ms").alias("start_time_ms"))


def summary_sets(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Count and mean of each metric by model, by embedding and by both, in one
    GROUPING SETS aggregate (grouping flags tell the sets apart)."""
    aggs = [F.count(F.lit(1)).alias("count")] + [F.avg(m).alias(f"mean_{m}") for m in metrics]
    return (df.groupingSets([["model"], ["embedding"], ["model", "embedding"]], "model", "embedding")
            .agg(*aggs, F.grouping("model").alias("g_model"), F.grouping("embedding").alias("g_embedding")))


def pivot_mean(df: DataFrame, row: str, col: str, values: Sequence[str], m: str) -> DataFrame:
    """Mean of a metric with ``row`` values as rows and explicit ``col`` values as columns."""
    return df.groupBy(row).pivot(col, list(values)).agg(F.avg(m))


def metric_heatmap(df: DataFrame, label: str, metrics: Sequence[str]) -> DataFrame:
    """Per-label metric means scaled to [0, 1] per metric, r2 higher-is-better, others
    inverted; a constant metric column gives null (0/0)."""
    means = df.groupBy(label).agg(*[F.avg(m).alias(m) for m in metrics])
    w = Window.partitionBy()
    # the means table has one row per label (a small dimension), so a global window is fine
    out = means
    for m in metrics:
        lo, hi = F.min(m).over(w), F.max(m).over(w)
        scaled = F.try_divide(F.col(m) - lo, hi - lo)
        out = out.withColumn(f"norm_{m}", scaled if "r2" in m else F.lit(1.0) - scaled)
    return out


def unpivot_params_metrics(df: DataFrame, params: Sequence[str], metrics: Sequence[str],
                           keep: Sequence[str]) -> DataFrame:
    """(parameter, value) x (metric, metric_value) long rows; null values dropped."""
    p = ", ".join(f"'{k}', CAST({k} AS STRING)" for k in params)
    m = ", ".join(f"'{k}', {k}" for k in metrics)
    d = df.selectExpr(*keep, *metrics, f"stack({len(params)}, {p}) AS (parameter, value)")
    d = d.selectExpr(*keep, "parameter", "value", f"stack({len(metrics)}, {m}) AS (metric, metric_value)")
    return d.where(F.col("value").isNotNull() & F.col("metric_value").isNotNull())


def param_summary_stats(long: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Mean, median, std (ddof 1), min, max, count per group (empty groups absent).
    Groups are (parameter, value, embedding, normalisation, metric) cells of a run
    table, i.e. a few hundred runs at most per cell; the exact median is the built-in
    one."""
    return long.groupBy(*groups).agg(
        F.avg("metric_value").alias("mean"), F.median("metric_value").alias("median"),
        F.stddev_samp("metric_value").alias("std"), F.min("metric_value").alias("min"),
        F.max("metric_value").alias("max"), F.count(F.lit(1)).alias("count"))


def param_effect_series(long: DataFrame, groups: Sequence[str], flag: str = "normalize_targets") -> DataFrame:
    """Mean and std (ddof 1, 0 when n = 1) per value for normalised and raw runs side
    by side; a value is kept when either side has data."""
    def side(b):
        v = F.when(F.col(flag) == F.lit(b), F.col("metric_value"))
        n = F.count(v)
        return [F.avg(v).alias(f"mean_{'norm' if b else 'raw'}"),
                F.when(n > 0, F.coalesce(F.stddev_samp(v), F.lit(0.0))).alias(f"std_{'norm' if b else 'raw'}"),
                n.alias(f"n_{'norm' if b else 'raw'}")]
    return long.groupBy(*groups).agg(*side(True), *side(False))


def boxplot_stats(long: DataFrame, groups: Sequence[str], value: str = "metric_value") -> DataFrame:
    """Five-number summary (linear percentiles), IQR whiskers clipped to the data, n."""
    q = long.groupBy(*groups).agg(
        F.min(value).alias("min"), F.percentile(value, F.lit(0.25)).alias("q1"),
        F.median(value).alias("median"), F.percentile(value, F.lit(0.75)).alias("q3"),
        F.max(value).alias("max"), F.count(F.lit(1)).alias("n"))
    iqr = F.col("q3") - F.col("q1")
    return (q.withColumn("whisker_lo", F.greatest(F.col("min"), F.col("q1") - 1.5 * iqr))
            .withColumn("whisker_hi", F.least(F.col("max"), F.col("q3") + 1.5 * iqr)))


def best_worst_by_median(box: DataFrame, part: Sequence[str], key: str, higher_is_better: Column) -> DataFrame:
    """Best and worst value by median, with metric direction."""
    s = F.struct(F.col("median"), F.col(key))
    return box.groupBy(*part).agg(
        F.max_by(key, s).alias("max_median_value"), F.min_by(key, s).alias("min_median_value"),
        F.first(higher_is_better).alias("_hib")).select(
        *part,
        F.when(F.col("_hib"), F.col("max_median_value")).otherwise(F.col("min_median_value")).alias("best_value"),
        F.when(F.col("_hib"), F.col("min_median_value")).otherwise(F.col("max_median_value")).alias("worst_value"))


def param_importance(trials: DataFrame, params: Sequence[str], value: str = "value") -> DataFrame:
    """A30 (re-aimed): share of objective variance explained by each parameter's values,
    sum_g n_g (mean_g - mean)^2 / (n var_pop)."""
    p = ", ".join(f"'{k}', {k}" for k in params)
    long = trials.selectExpr("study", value, f"stack({len(params)}, {p}) AS (param, pvalue)")
    tot = trials.groupBy("study").agg(F.avg(value).alias("mu"), F.var_pop(value).alias("var"),
                                      F.count(value).alias("n"))
    grp = long.groupBy("study", "param", "pvalue").agg(F.avg(value).alias("m"), F.count(value).alias("c"))
    j = grp.join(tot, "study")
    return j.groupBy("study", "param").agg(
        F.try_divide(F.sum(F.col("c") * (F.col("m") - F.col("mu")) ** 2), F.first("n") * F.first("var"))
        .alias("importance"))


def pairs_by_mode(artefacts: DataFrame, mode: str = "prediction_mode", name: str = "name") -> DataFrame:
    """Artefacts grouped by prediction mode (sorted name list and count)."""
    return artefacts.groupBy(mode).agg(F.array_join(F.sort_array(F.collect_list(name)), ",").alias("names"),
                                       F.count(F.lit(1)).alias("n"))


def grid_from_dimensions(dims: DataFrame, names: Sequence[str]) -> DataFrame:
    """J7 building block: cartesian grid of small value lists held as arrays in one row
    (explode per dimension: no join)."""
    out = dims
    for n in names:
        out = out.withColumn(n, F.explode(F.col(n)))
    return out


def best_so_far(trials: DataFrame, value: str = "value") -> DataFrame:
    """Running minimum of the objective over trial numbers per study (failed trials,
    value null, do not change it).  Rows are windowed within blocks of numbers; the best of
    all earlier blocks comes from one row a block, so a study is not one task.  A range
    frame makes rows sharing a trial number see the same value."""
    t = trials.select("study", "number", F.col(value).alias("_v"), F.floor(F.col("number") / BLOCK).alias("_block"))
    before = Window.partitionBy("study").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = (t.groupBy("study", "_block").agg(F.min("_v").alias("_m"))
               .select("study", "_block", F.min("_m").over(before).alias("_earlier")))
    w = Window.partitionBy("study", "_block").orderBy("number").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return (t.withColumn("_in", F.min("_v").over(w)).join(earlier, ["study", "_block"])
            .select("study", "number", F.least("_in", "_earlier").alias("best_so_far")))


def early_stop(history: DataFrame, key: str = "val_loss", patience: int = 30) -> DataFrame:
    """Best value/epoch and the epoch where training would stop: the first epoch
    after ``patience`` consecutive epochs without a strict improvement of the best."""
    h = history.where(F.col("key") == key)
    w_prev = Window.partitionBy("run_id").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    h = h.withColumn("_best_before", F.min("value").over(w_prev))
    h = h.withColumn("_improved", F.col("_best_before").isNull() | (F.col("value") < F.col("_best_before")))
    w_run = Window.partitionBy("run_id").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    h = h.withColumn("_seen", F.row_number().over(Window.partitionBy("run_id").orderBy("step")))  # observed epochs
    h = h.withColumn("_last_imp", F.max(F.when(F.col("_improved"), F.col("_seen"))).over(w_run))
    h = h.withColumn("_since", F.col("_seen") - F.col("_last_imp"))
    return h.groupBy("run_id").agg(
        F.min("value").alias("best_value"),
        F.min_by("step", F.struct("value", "step")).alias("best_epoch"),
        F.min(F.when(F.col("_since") >= patience, F.col("step"))).alias("stop_epoch"),
        F.max("step").alias("last_epoch"))


def best_trial(trials: DataFrame, params: Sequence[str], direction: str = "minimize") -> DataFrame:
    """Best trial per study; failed trials count as +inf; maximised objectives
    (r2) are negated before taking the minimum."""
    obj = F.coalesce(F.col("value") * (-1.0 if direction == "maximize" else 1.0), F.lit(float("inf")))
    t = trials.withColumn("_obj", obj)
    key = F.struct("_obj", "number")
    return t.groupBy("study").agg(F.min_by("number", key).alias("best_number"),
                                  F.min("_obj").alias("best_objective"),
                                  *[F.min_by(p, key).alias(p) for p in params])


def study_history(trials: DataFrame) -> DataFrame:
    """Completed trials only: count, best value and its trial number."""
    c = trials.where(F.col("state") == "COMPLETE")
    return c.groupBy("study").agg(F.count(F.lit(1)).alias("n_complete"), F.min("value").alias("best_value"),
                                  F.min_by("number", F.struct("value", "number")).alias("best_number"))
