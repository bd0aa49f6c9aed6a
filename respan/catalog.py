"""Fixture tables derived from the generated test data.

The library itself works on any tables with the documented schemas (see
``FIXTURES.md``).  For tests, the benchmark and the SQL oracle we derive those
tables from the generated Parquet files with plain column arithmetic; each
derivation exists twice, once as a Spark DataFrame and once as DuckDB SQL text
(``FIXTURE_SQL``), so that the oracle runs the same inputs.

Derived tables and their sources:

================  ==============  ==================================================
fixture           source table    notes
================  ==============  ==================================================
dsl_docs          documents       base_name = 'model_<doc_id>'
measurements      events          user_id -> base_name; every 97th value null,
                                  every 89th time null; time in seconds since 2024
predictions       events          y = value, yhat = value + ((id*37)%101-50)/25,
                                  model m0..m2, hash split train/val/test,
                                  extra targets 0.7y / 1.3y
features          embeddings      target = label + 3*x[0] - x[4]
runs              orders          experiment-run log with MAP params / metrics
metric_history    lineitem        (run, key, step) -> min value
trials            lineitem        optimisation trials of 8 studies
attention_edges   lineitem        (doc, layer, head, from, to, weight)
================  ==============  ==================================================
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from respan.functions.hashing import sql_uniform, uniform

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

EPOCH_2024_US = 1704067200 * 1_000_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# --------------------------------------------------------------------------- Spark


def dsl_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents")
    return d.select(
        F.concat(F.lit("model_"), F.col("doc_id").cast("string")).alias("base_name"),
        F.col("text").alias("tpcm_text"),
    )


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("model_"), F.col("user_id").cast("string")).alias("base_name"),
        F.col("event_id").alias("row_id"),
        F.when(F.col("event_id") % 89 == 0, F.lit(None).cast("double"))
        .otherwise((F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(EPOCH_2024_US)) / F.lit(1e6))
        .alias("point_in_time"),
        F.when(F.col("event_id") % 97 == 0, F.lit(None).cast("double"))
        .otherwise(F.col("value"))
        .alias("response_time"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    u = uniform("event_id")
    yhat = F.col("value") + ((F.col("event_id") * 37) % 101 - 50) / F.lit(25.0)
    return e.select(
        F.col("event_id").alias("row_id"),
        F.concat(F.lit("m"), (F.col("event_id") % 3).cast("string")).alias("model"),
        F.when(u < 0.7, "train").when(u < 0.85, "val").otherwise("test").alias("split"),
        F.col("value").alias("y"),
        yhat.alias("yhat"),
        (F.col("value") * 0.7).alias("y_min"),
        (F.col("value") * 1.3).alias("y_max"),
        (yhat * 0.7).alias("p_min"),
        (yhat * 1.3 - (F.col("event_id") % 7) / F.lit(10.0)).alias("p_max"),
    )


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "embeddings")
    x = F.col("embedding").cast("array<double>")
    return e.select(
        F.col("vec_id").alias("row_id"),
        x.alias("x"),
        (F.col("label") + 3 * F.element_at(x, 1) - F.element_at(x, 5)).alias("target"),
    )


_MODELS = ["rf", "ridge", "lasso", "svm", "torch"]
_EMBEDDINGS = ["tfidf", "bert", "llama"]
_NORM_STRINGS = ["true", "True", "false", "False", "maybe"]
_N_EST = ["5", "10", "20", "50"]
_DEPTH = ["3", "5", "7"]
_ALPHA = ["0.001", "0.01", "0.1", "1.0", "10.0", "bad"]
_C = ["0.01", "0.1", "1", "10", "100"]
_KERNEL = ["linear", "rbf", "poly", "sigmoid"]
_LR = ["0.001", "0.01", "0.1"]
_BATCH = ["16", "32", "64"]
_EPOCHS = ["50", "100"]


def _pick(values, idx: F.Column) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx % len(values) + 1).cast("int"))


def _runs_wide_spark(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    c = F.col("o_custkey")
    model = _pick(_MODELS, k)
    emb = _pick(_EMBEDDINGS, c)
    status = (F.when(F.col("o_orderstatus") == "P", "FAILED")
              .when(F.col("o_orderstatus") == "O", "RUNNING").otherwise("FINISHED"))
    kdiv5 = F.expr("o_orderkey div 5")
    kdiv20 = F.expr("o_orderkey div 20")
    missing = (k % 11 == 0)
    w = o.select(
        F.concat(F.lit("r"), k.cast("string")).alias("run_id"),
        (k % 4).cast("string").alias("experiment_id"),
        status.alias("status"),
        (F.unix_millis(F.col("o_orderdate").cast("timestamp")) + (k % 86400) * 1000).alias("start_time_ms"),
        F.col("o_custkey").alias("custkey"),
        F.col("o_totalprice").alias("price"),
        k.alias("k"),
        model.alias("model_type"),
        emb.alias("embedding_type"),
        _pick(_NORM_STRINGS, c).alias("normalize_targets"),
        F.when((model == "rf") & ~missing, _pick(_N_EST, kdiv5)).alias("n_estimators"),
        F.when(model == "rf", _pick(_DEPTH, kdiv20)).alias("max_depth"),
        F.when(model.isin("ridge", "lasso") & ~missing, _pick(_ALPHA, kdiv5)).alias("alpha"),
        F.when((model == "svm") & ~missing, _pick(_C, kdiv5)).alias("C"),
        F.when(model == "svm", _pick(_KERNEL, kdiv20)).alias("kernel"),
        F.when((model == "torch") & ~missing, _pick(_LR, kdiv5)).alias("learning_rate"),
        F.when(model == "torch", _pick(_BATCH, kdiv20)).alias("batch_size"),
        F.when(model == "torch", _pick(_EPOCHS, kdiv20)).alias("epochs"),
        F.when(k % 13 != 0, emb).alias("embedding"),
        model.alias("model"),
        F.lit("summary").alias("prediction_mode"),
    )
    k = F.col("k")
    kdiv5 = F.expr("k div 5")
    swept = (F.when(F.col("model_type") == "rf", F.concat(F.lit("n_estimators="), _pick(_N_EST, kdiv5)))
             .when(F.col("model_type").isin("ridge", "lasso"), F.concat(F.lit("alpha="), _pick(_ALPHA, kdiv5)))
             .when(F.col("model_type") == "svm", F.concat(F.lit("C="), _pick(_C, kdiv5)))
             .otherwise(F.concat(F.lit("learning_rate="), _pick(_LR, kdiv5))))
    norm_word = F.when(F.lower(F.col("normalize_targets")) == "true", "true").otherwise("false")
    p = F.col("price")
    w = w.select(
        "*",
        F.concat(swept, F.lit("_model="), F.col("model_type"), F.lit("_emb="), F.col("embedding_type"),
                 F.lit("_norm="), norm_word, F.lit("_run"), (k % 3 + 1).cast("string")).alias("run_name"),
        F.when(F.col("status") == "RUNNING", F.lit(None).cast("bigint"))
        .otherwise(F.col("start_time_ms") + F.col("custkey") * 1000).alias("end_time_ms"),
        F.when(F.col("status") != "FAILED", p / 100000.0).alias("val_mse_avg"),
        F.when(F.col("status") != "FAILED", F.sqrt(p) / 100.0).alias("val_mae_avg"),
        F.when(F.col("status") != "FAILED", 1.0 - p / 300000.0).alias("val_r2_avg"),
        F.when(F.col("status") == "FINISHED", p / 90000.0).alias("test_mse_avg"),
        F.when(F.col("status") == "FINISHED", F.sqrt(p) / 90.0).alias("test_mae_avg"),
        F.when(F.col("status") == "FINISHED", 1.0 - p / 270000.0).alias("test_r2_avg"),
    )
    return w


RUN_PARAM_KEYS = ["model_type", "model", "embedding", "prediction_mode", "normalize_targets", "n_estimators",
                  "max_depth", "alpha", "C", "kernel", "learning_rate", "batch_size", "epochs"]
RUN_METRIC_KEYS = ["val_mse_avg", "val_mae_avg", "val_r2_avg", "test_mse_avg", "test_mae_avg",
                   "test_r2_avg"]


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Experiment-run log: one row per run, params and metrics as MAP columns."""
    w = _runs_wide_spark(spark, sf_dir)

    def to_map(keys, value_type):
        entries = F.array(*[F.struct(F.lit(key).alias("key"), F.col(key).cast(value_type).alias("value"))
                            for key in keys])
        return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))

    return w.select(
        "run_id", "experiment_id", "run_name", "status", "start_time_ms", "end_time_ms",
        to_map(RUN_PARAM_KEYS, "string").alias("params"),
        to_map(RUN_METRIC_KEYS, "double").alias("metrics"),
    )


def metric_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    return (li.select(
        F.concat(F.lit("r"), F.col("l_orderkey").cast("string")).alias("run_id"),
        _pick(["train_loss", "val_loss", "learning_rate"], F.col("l_partkey")).alias("key"),
        F.col("l_linenumber").alias("step"),
        (F.col("l_extendedprice") / 1000.0).alias("value"))
        .repartition("run_id")  # nearly every row is a group: an input split's groups are no longer held by one task
        .groupBy("run_id", "key", "step").agg(F.min("value").alias("value")))


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    failed = F.col("l_partkey") % 13 == 0
    return li.select(
        F.concat(F.lit("s"), (F.col("l_orderkey") % 8).cast("string")).alias("study"),
        (F.expr("l_orderkey div 8") * 8 + F.col("l_linenumber")).cast("bigint").alias("number"),
        F.when(failed, "FAIL").otherwise("COMPLETE").alias("state"),
        F.when(failed, F.lit(None).cast("double"))
        .otherwise(F.col("l_extendedprice") / F.col("l_quantity") / 100.0).alias("value"),
        F.create_map(
            F.lit("n_estimators"), _pick(["5", "10", "20"], F.col("l_suppkey")),
            F.lit("max_depth"), _pick(["3", "5", "7"], F.col("l_partkey")),
        ).alias("params"),
    )


def attention_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("doc"),
        (F.col("l_linenumber") % 2).cast("int").alias("layer"),
        (F.expr("l_partkey div 16") % 4).cast("int").alias("head"),
        (F.col("l_partkey") % 16).cast("int").alias("from_pos"),
        (F.col("l_suppkey") % 16).cast("int").alias("to_pos"),
        (F.col("l_quantity") / 50.0).alias("weight"),
    )


def document_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attention edges between the tokens of ``documents`` (three layers, four heads)."""
    docs = read_table(spark, sf_dir, "documents")
    n_docs = docs.agg(F.max("doc_id") + 1).first()[0]
    size = docs.select(F.col("doc_id").alias("doc"), F.size(F.split("text", r"\s+")).cast("long").alias("n"))
    li = read_table(spark, sf_dir, "lineitem").withColumn("doc", F.col("l_orderkey") % n_docs).join(size, "doc")
    return li.select("doc", F.expr("cast(l_linenumber % 3 as int)").alias("layer"), F.expr("cast(l_partkey div 16 % 4 as int)").alias("head"),
                     F.expr("cast((l_partkey % n) * (l_suppkey % n) div n as int)").alias("from_pos"),
                     F.expr("cast((l_partkey % n) * (l_orderkey % n) div n as int)").alias("to_pos"),
                     (F.col("l_quantity") / 50.0).alias("weight"))


# --------------------------------------------------------------------------- DuckDB twins


def _sql_pick(values, idx: str) -> str:
    arr = ", ".join(f"'{v}'" for v in values)
    return f"([{arr}])[({idx}) % {len(values)} + 1]"


_PRED_U = sql_uniform("event_id")

FIXTURE_SQL = {
    "dsl_docs": "SELECT 'model_' || CAST(doc_id AS VARCHAR) AS base_name, text AS tpcm_text FROM documents",
    "measurements": (
        "SELECT 'model_' || CAST(user_id AS VARCHAR) AS base_name, event_id AS row_id, "
        "CASE WHEN event_id % 89 = 0 THEN NULL ELSE (epoch_us(ts) - 1704067200000000) / 1000000.0 END "
        "AS point_in_time, "
        "CASE WHEN event_id % 97 = 0 THEN NULL ELSE value END AS response_time FROM events"
    ),
    "predictions": (
        "SELECT event_id AS row_id, 'm' || CAST(event_id % 3 AS VARCHAR) AS model, "
        f"CASE WHEN {_PRED_U} < 0.7 THEN 'train' WHEN {_PRED_U} < 0.85 THEN 'val' ELSE 'test' END AS split, "
        "value AS y, value + ((event_id * 37) % 101 - 50) / 25.0 AS yhat, "
        "value * 0.7 AS y_min, value * 1.3 AS y_max, "
        "(value + ((event_id * 37) % 101 - 50) / 25.0) * 0.7 AS p_min, "
        "(value + ((event_id * 37) % 101 - 50) / 25.0) * 1.3 - (event_id % 7) / 10.0 AS p_max "
        "FROM events"
    ),
    "features": (
        "SELECT vec_id AS row_id, CAST(embedding AS DOUBLE[]) AS x, "
        "label + 3 * CAST(embedding[1] AS DOUBLE) - CAST(embedding[5] AS DOUBLE) AS target FROM embeddings"
    ),
    "metric_history": (
        "SELECT run_id, key, step, min(value) AS value FROM ("
        "SELECT 'r' || CAST(l_orderkey AS VARCHAR) AS run_id, "
        f"{_sql_pick(['train_loss', 'val_loss', 'learning_rate'], 'l_partkey')} AS key, "
        "l_linenumber AS step, l_extendedprice / 1000.0 AS value FROM lineitem) GROUP BY run_id, key, step"
    ),
    "trials": (
        "SELECT 's' || CAST(l_orderkey % 8 AS VARCHAR) AS study, "
        "CAST((l_orderkey // 8) * 8 + l_linenumber AS BIGINT) AS number, "
        "CASE WHEN l_partkey % 13 = 0 THEN 'FAIL' ELSE 'COMPLETE' END AS state, "
        "CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE l_extendedprice / l_quantity / 100.0 END AS value, "
        f"{_sql_pick(['5', '10', '20'], 'l_suppkey')} AS n_estimators, "
        f"{_sql_pick(['3', '5', '7'], 'l_partkey')} AS max_depth FROM lineitem"
    ),
    "document_edges": (
        "SELECT doc, CAST(l_linenumber % 3 AS INTEGER) AS layer, CAST((l_partkey // 16) % 4 AS INTEGER) AS head, "
        "CAST((l_partkey % n) * (l_suppkey % n) // n AS INTEGER) AS from_pos, "
        "CAST((l_partkey % n) * (l_orderkey % n) // n AS INTEGER) AS to_pos, l_quantity / 50.0 AS weight "
        "FROM (SELECT *, l_orderkey % (SELECT max(doc_id) + 1 FROM documents) AS doc FROM lineitem) JOIN "
        "(SELECT doc_id AS doc, CAST(len(regexp_split_to_array(text, '\\s+')) AS BIGINT) AS n FROM documents) USING (doc)"
    ),
    "attention_edges": (
        "SELECT l_orderkey AS doc, CAST(l_linenumber % 2 AS INTEGER) AS layer, "
        "CAST((l_partkey // 16) % 4 AS INTEGER) AS head, CAST(l_partkey % 16 AS INTEGER) AS from_pos, "
        "CAST(l_suppkey % 16 AS INTEGER) AS to_pos, l_quantity / 50.0 AS weight FROM lineitem"
    ),
}

_K = "o_orderkey"
_RUN_MODEL = _sql_pick(_MODELS, _K)
_MISSING = f"({_K} % 11 = 0)"
FIXTURE_SQL["runs"] = f"""
SELECT *, {_MISSING} AS _missing FROM (
SELECT 'r' || CAST({_K} AS VARCHAR) AS run_id,
       CAST({_K} % 4 AS VARCHAR) AS experiment_id,
       CASE o_orderstatus WHEN 'P' THEN 'FAILED' WHEN 'O' THEN 'RUNNING' ELSE 'FINISHED' END AS status,
       epoch_ms(o_orderdate) + ({_K} % 86400) * 1000 AS start_time_ms,
       o_custkey, o_totalprice AS price, {_K},
       {_RUN_MODEL} AS model_type,
       {_sql_pick(_EMBEDDINGS, 'o_custkey')} AS embedding_type,
       {_sql_pick(_NORM_STRINGS, 'o_custkey')} AS normalize_targets,
       {_sql_pick(_N_EST, f'{_K} // 5')} AS sweep_n_estimators,
       {_sql_pick(_ALPHA, f'{_K} // 5')} AS sweep_alpha,
       {_sql_pick(_C, f'{_K} // 5')} AS sweep_C,
       {_sql_pick(_LR, f'{_K} // 5')} AS sweep_learning_rate,
       {_sql_pick(_DEPTH, f'{_K} // 20')} AS v_max_depth,
       {_sql_pick(_KERNEL, f'{_K} // 20')} AS v_kernel,
       {_sql_pick(_BATCH, f'{_K} // 20')} AS v_batch_size,
       {_sql_pick(_EPOCHS, f'{_K} // 20')} AS v_epochs
FROM orders) o
"""
FIXTURE_SQL["runs_wide"] = f"""
SELECT run_id, experiment_id, status, start_time_ms,
       CASE WHEN status = 'RUNNING' THEN NULL ELSE start_time_ms + o_custkey * 1000 END AS end_time_ms,
       model_type, embedding_type, normalize_targets,
       CASE WHEN model_type = 'rf' AND NOT _missing THEN sweep_n_estimators END AS n_estimators,
       CASE WHEN model_type = 'rf' THEN v_max_depth END AS max_depth,
       CASE WHEN model_type IN ('ridge', 'lasso') AND NOT _missing THEN sweep_alpha END AS alpha,
       CASE WHEN model_type = 'svm' AND NOT _missing THEN sweep_C END AS C,
       CASE WHEN model_type = 'svm' THEN v_kernel END AS kernel,
       CASE WHEN model_type = 'torch' AND NOT _missing THEN sweep_learning_rate END AS learning_rate,
       CASE WHEN model_type = 'torch' THEN v_batch_size END AS batch_size,
       CASE WHEN model_type = 'torch' THEN v_epochs END AS epochs,
       CASE WHEN o_orderkey % 13 <> 0 THEN embedding_type END AS embedding,
       CASE WHEN model_type = 'rf' THEN 'n_estimators=' || sweep_n_estimators
            WHEN model_type IN ('ridge', 'lasso') THEN 'alpha=' || sweep_alpha
            WHEN model_type = 'svm' THEN 'C=' || sweep_C
            ELSE 'learning_rate=' || sweep_learning_rate END
         || '_model=' || model_type || '_emb=' || embedding_type || '_norm='
         || CASE WHEN lower(normalize_targets) = 'true' THEN 'true' ELSE 'false' END
         || '_run' || CAST({_K} % 3 + 1 AS VARCHAR) AS run_name,
       CASE WHEN status <> 'FAILED' THEN price / 100000.0 END AS val_mse_avg,
       CASE WHEN status <> 'FAILED' THEN sqrt(price) / 100.0 END AS val_mae_avg,
       CASE WHEN status <> 'FAILED' THEN 1.0 - price / 300000.0 END AS val_r2_avg,
       CASE WHEN status = 'FINISHED' THEN price / 90000.0 END AS test_mse_avg,
       CASE WHEN status = 'FINISHED' THEN sqrt(price) / 90.0 END AS test_mae_avg,
       CASE WHEN status = 'FINISHED' THEN 1.0 - price / 270000.0 END AS test_r2_avg
FROM runs_base
"""


def with_fixtures(sql: str, *names: str) -> str:
    """Prefix an oracle statement with the CTEs of the fixtures it uses."""
    ctes = []
    for n in names:
        if n == "runs_wide":
            ctes.append(f"runs_base AS ({FIXTURE_SQL['runs']})")
        ctes.append(f"{n} AS ({FIXTURE_SQL[n]})")
    return "WITH " + ",\n".join(ctes) + "\n" + sql


@lru_cache(maxsize=None)
def fixture_names() -> tuple:
    return ("dsl_docs", "measurements", "predictions", "features", "runs", "metric_history", "trials",
            "attention_edges")


def model_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three models scoring every event (model m2 misses every 50th row)."""
    e = read_table(spark, sf_dir, "events")
    u = uniform("event_id")
    k = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k")
    d = e.select("event_id", "value", k)
    noise = ((F.col("event_id") * (37 + 6 * F.col("k"))) % 101 - 50) / (25.0 + 5 * F.col("k"))
    d = d.select(
        F.col("event_id").alias("row_id"),
        F.concat(F.lit("m"), F.col("k").cast("string")).alias("model"),
        F.when(u < 0.7, "train").when(u < 0.85, "val").otherwise("test").alias("split"),
        F.col("value").alias("y"),
        (F.col("value") + noise).alias("yhat"))
    return d.where(~((F.col("model") == "m2") & (F.col("row_id") % 50 == 0)))


FIXTURE_SQL["model_predictions"] = (
    "SELECT event_id AS row_id, 'm' || CAST(k AS VARCHAR) AS model, "
    f"CASE WHEN {_PRED_U} < 0.7 THEN 'train' WHEN {_PRED_U} < 0.85 THEN 'val' ELSE 'test' END AS split, "
    "value AS y, value + ((event_id * (37 + 6 * k)) % 101 - 50) / (25.0 + 5 * k) AS yhat "
    "FROM events, (SELECT unnest(range(0, 3)) AS k) ks "
    "WHERE NOT (k = 2 AND event_id % 50 = 0)"
)
