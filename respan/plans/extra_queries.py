"""Registered queries: baseline table, training history, batch counters, comprehensive
evaluation, run-frame union and filter-priority latest run."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from respan import catalog as C
from respan.catalog import with_fixtures
from respan.operators import metrics as M
from respan.operators import models as MD
from respan.operators import runs as R
from respan.operators.split import exact_split, split_sql
from respan.plans.evaluation_queries import _BOOT_SQL, _N_BOOT, _R2_SQL, _SAMPLES_SQL, _samples
from respan.plans.registry import r6, register


def _fx(body: str, *names: str, extra: str = "") -> str:
    sql = with_fixtures("", *names)
    if extra:
        sql = sql.rstrip() + ",\n" + extra.strip() + "\n"
    return sql + body


_BT_SQL = _SAMPLES_SQL + ", sp AS (" + split_sql("samples", ["base_name"]) + """),
st AS (SELECT avg(avg_resp_time) AS m, coalesce(nullif(stddev_pop(avg_resp_time), 0), 1.0) AS s FROM sp WHERE split = 'train'),
sc AS (SELECT split, false AS normalized, avg_resp_time AS y, m AS yhat FROM sp, st
       UNION ALL SELECT split, true, (avg_resp_time - m) / s, 0.0 FROM sp, st)
"""


@register("baseline_table", _fx(
    f"""SELECT normalized, split, {r6('avg((y - yhat) ^ 2)', 'mse')}, {r6('avg(abs(y - yhat))', 'mae')},
        {r6(_R2_SQL, 'r2')}, {r6('sqrt(avg((y - yhat) ^ 2))', 'rmse')}
        FROM sc WHERE split IN ('val', 'test') GROUP BY normalized, split""",
    "dsl_docs", "measurements", extra=_BT_SQL))
def q_baseline_table(spark, sf):
    """Train-mean predictor scored on val and test, raw and standardised targets."""
    s = exact_split(_samples(spark, sf), ["base_name"])
    sc = MD.target_scaler(s.where(F.col("split") == "train"), "avg_resp_time")
    raw = s.select("split", F.lit(False).alias("normalized"), F.col("avg_resp_time").alias("y"),
                   F.lit(sc["mean"]).alias("yhat"))
    z = MD.scale_targets(s, "avg_resp_time", sc).select("split", F.lit(True).alias("normalized"),
                                                        F.col("y_scaled").alias("y"), F.lit(0.0).alias("yhat"))
    both = raw.unionByName(z).where(F.col("split").isin("val", "test"))
    return M.regression_metrics(both, ["normalized", "split"], relative=False).drop("n")


@register("training_history", _fx(
    """SELECT s.run_id, CAST(s.epoch AS INTEGER) AS epoch,
         """ + ", ".join(r6(f"max(CASE WHEN h.key = '{k}' THEN h.value END)", k)
                         for k in ["train_loss", "val_loss", "learning_rate"]) + """
       FROM (SELECT run_id, unnest(range(1, max(step) + 1)) AS epoch FROM metric_history GROUP BY run_id) s
       LEFT JOIN metric_history h ON h.run_id = s.run_id AND h.step = s.epoch
       GROUP BY s.run_id, s.epoch""", "metric_history"))
def q_training_history(spark, sf):
    """(key, step, value) pivoted per run on a dense epoch spine 1..max step."""
    h = C.metric_history(spark, sf)  # its rows stand together by run, for all three groupings
    spine = h.groupBy("run_id").agg(F.max("step").alias("m")).select(
        "run_id", F.explode(F.sequence(F.lit(1), F.col("m"))).alias("epoch"))
    wide = h.groupBy("run_id", F.col("step").alias("epoch")).pivot(
        "key", ["train_loss", "val_loss", "learning_rate"]).agg(F.first("value"))
    return spine.join(wide, ["run_id", "epoch"], "left").withColumn("epoch", F.col("epoch").cast("int"))


@register("batch_counters", _fx(
    "SELECT experiment_id, count(*) AS total, count(*) FILTER (WHERE status <> 'FAILED') AS ok, "
    "count(*) FILTER (WHERE status = 'FAILED') AS failed FROM runs_wide GROUP BY experiment_id", "runs_wide"))
def q_batch_counters(spark, sf):
    """Total / succeeded / failed units per batch (experiment)."""
    r = C.runs(spark, sf)
    return r.groupBy("experiment_id").agg(F.count(F.lit(1)).alias("total"),
                                          F.count(F.when(F.col("status") != "FAILED", 1)).alias("ok"),
                                          F.count(F.when(F.col("status") == "FAILED", 1)).alias("failed"))


@register("comprehensive_eval", _fx(
    f"""SELECT m.split, m.model, m.metric, {r6('m.value', 'value')}, {r6('ci.ci_lower', 'ci_lower')},
          {r6('ci.ci_upper', 'ci_upper')}, m.n AS n_samples,
          CAST({_N_BOOT} AS DOUBLE) AS n_bootstrap
        FROM (SELECT split, model, metric, value, n FROM (UNPIVOT (
                SELECT split, model, count(*) AS n, avg((y - yhat) ^ 2) AS mse, avg(abs(y - yhat)) AS mae,
                       sqrt(avg((y - yhat) ^ 2)) AS rmse, {_R2_SQL} AS r2
                FROM model_predictions GROUP BY split, model) ON mse, mae, r2, rmse INTO NAME metric VALUE value)) m
        LEFT JOIN ci ON ci.split = m.split AND ci.model = m.model AND ci.metric = m.metric""",
    "model_predictions", extra=_BOOT_SQL))
def q_comprehensive(spark, sf):
    """M10 (metric part): train/val/test metrics per model with bootstrap CIs on all three."""
    p = C.model_predictions(spark, sf)
    pm = M.regression_metrics(p, ["split", "model"], relative=False)
    pm = pm.selectExpr("split", "model", "n AS n_samples",
                       "stack(4, 'mse', mse, 'mae', mae, 'r2', r2, 'rmse', rmse) AS (metric, value)")
    ci = M.bootstrap_ci(p, ["split", "model"], n_boot=_N_BOOT).drop("ci_width")
    out = pm.join(ci, ["split", "model", "metric"], "left")
    return out.withColumn("n_bootstrap", F.lit(_N_BOOT).cast("double"))


@register("union_runs", _fx(
    """SELECT run_id, model_type, n_estimators, NULL AS alpha FROM runs_wide WHERE model_type = 'rf'
       UNION ALL SELECT run_id, model_type, NULL, alpha FROM runs_wide WHERE model_type IN ('ridge', 'lasso')""",
    "runs_wide"))
def q_union_runs(spark, sf):
    """Set operation: run frames with different parameter columns concatenated by name."""
    r = C.runs(spark, sf)
    rf = r.where(R.param("model_type") == "rf").select("run_id", R.param("model_type").alias("model_type"),
                                                       R.param("n_estimators").alias("n_estimators"))
    lin = r.where(R.param("model_type").isin("ridge", "lasso")).select(
        "run_id", R.param("model_type").alias("model_type"), R.param("alpha").alias("alpha"))
    return rf.unionByName(lin, allowMissingColumns=True)


_TARGETS = [("rf", "bert"), ("svm", "tfidf"), ("torch", "llama")]


@register("latest_run_priority", _fx(
    """SELECT target_model, target_embedding, arg_max(run_id, (-priority, start_time_ms, run_id)) AS run_id,
              CAST(min(priority) AS INTEGER) AS priority
       FROM (SELECT t.m AS target_model, t.e AS target_embedding, w.run_id, w.start_time_ms,
                    CASE WHEN w.model_type = t.m AND w.embedding = t.e AND w.status = 'FINISHED' THEN 1
                         WHEN w.model_type = t.m AND w.embedding = t.e THEN 2 ELSE 3 END AS priority
             FROM runs_wide w JOIN (VALUES """ + ", ".join(f"('{m}', '{e}')" for m, e in _TARGETS)
    + """) t(m, e) ON w.model_type = t.m)
       GROUP BY target_model, target_embedding""", "runs_wide"))
def q_latest_priority(spark, sf):
    """Latest run matching the first non-empty of three filters (model+embedding+finished,
    model+embedding, model) for each requested (model, embedding)."""
    r = C.runs(spark, sf)
    targets = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(e).alias("e")) for m, e in _TARGETS])
    t = r.select("run_id", "status", "start_time_ms", R.param("model_type").alias("model_type"),
                 R.param("embedding").alias("embedding"), F.explode(targets).alias("t"))
    t = t.where(F.col("model_type") == F.col("t.m"))
    both = (F.col("model_type") == F.col("t.m")) & (F.col("embedding") == F.col("t.e"))
    pr = F.when(both & (F.col("status") == "FINISHED"), 1).when(both, 2).otherwise(3)
    t = t.select(F.col("t.m").alias("target_model"), F.col("t.e").alias("target_embedding"), "run_id",
                 "start_time_ms", pr.alias("priority"))
    return t.groupBy("target_model", "target_embedding").agg(
        F.max_by("run_id", F.struct((-F.col("priority")).alias("p"), "start_time_ms", "run_id")).alias("run_id"),
        F.min("priority").cast("int").alias("priority"))
