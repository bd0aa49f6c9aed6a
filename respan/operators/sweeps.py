"""Named and nested one-factor sweeps (M12) and grids with values per model.

A set names sweeps or other sets; :func:`expand_sets` resolves the nesting with a recursive
query.  A sweep varies one parameter over its values and leaves the others at the baseline; the
baseline's own row comes first.  Value lists are tables (model, parameter, value), taken
from a run log in one pass or given.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed values (named sets and baseline of the reference): set -> members, sweep -> (parameter, model or None)
SETS = {
    "svm-analysis": ["svm-regularization", "svm-kernels", "svm-epsilon", "svm-gamma"],
    "model-comparison": ["model-types", "embedding-impact"],
    "preprocessing-analysis": ["normalization-impact"],
    "rf-optimization": ["rf-trees", "rf-depth"],
    "linear-analysis": ["linear-regularization"],
    "linear-regularization": ["linear-ridge", "linear-lasso"],
    "neural-optimization": ["nn-batch-size", "nn-epochs", "nn-learning-rate", "nn-dropout"],
    "complete-analysis": ["svm-analysis", "model-comparison", "preprocessing-analysis", "rf-optimization", "linear-analysis",
                          "neural-optimization"],
}
SWEEPS = {
    "svm-regularization": ("C", None), "svm-kernels": ("kernel", None), "svm-epsilon": ("epsilon", None), "svm-gamma": ("gamma", None),
    "model-types": ("model", None), "embedding-impact": ("embedding", None), "normalization-impact": ("normalize_targets", None),
    "rf-trees": ("n_estimators", "rf"), "rf-depth": ("max_depth", "rf"), "linear-ridge": ("alpha", "ridge"), "linear-lasso": ("alpha", "lasso"),
    "nn-batch-size": ("batch_size", "torch"), "nn-epochs": ("epochs", "torch"), "nn-learning-rate": ("learning_rate", "torch"),
    "nn-dropout": ("dropout_rate", "torch"),
}
BASELINE = {"model": "svm", "embedding": "tfidf", "normalize_targets": "false", "C": "1.0", "epsilon": "0.1", "kernel": "rbf", "gamma": "scale",
            "degree": "3", "n_estimators": "10", "max_depth": "5", "alpha": "1.0", "batch_size": "128", "epochs": "100",
            "learning_rate": "0.0008", "dropout_rate": "0.3"}
MODEL_KEYS = {"svm": ["C", "epsilon", "kernel", "gamma", "degree"], "rf": ["n_estimators", "max_depth"], "ridge": ["alpha"],
              "lasso": ["alpha"], "torch": ["batch_size", "epochs", "learning_rate", "dropout_rate"]}
N_RUNS = 3

#: Parameters that every model has.
SHARED = ("model", "embedding", "normalize_targets")


def expand_sets(spark: SparkSession, members: DataFrame) -> DataFrame:
    """(root, name) of every set and all that it names, directly or through other sets, itself
    included; what is reached on several ways comes once.  ``members``: (parent, child), without cycles
    (the session's limit of recursion levels ends one with an error)."""
    view = f"members_{uuid.uuid4().hex}"
    members.select("parent", "child").createOrReplaceTempView(view)
    return spark.sql(f"""
        WITH RECURSIVE reach(root, name) AS (
            SELECT DISTINCT parent, child FROM {view}
            UNION ALL SELECT reach.root, m.child FROM reach JOIN {view} m ON m.parent = reach.name)
        SELECT root, name FROM reach UNION SELECT parent, parent FROM {view} UNION SELECT child, child FROM {view}""")


def values_by_model(runs: DataFrame, parameters: Sequence[str]) -> DataFrame:
    """(model, parameter, value): the distinct values in a run log, read once."""
    entry = F.explode(F.map_entries(F.map_filter("params", lambda k, v: k.isin(list(parameters)))))
    pairs = runs.select(F.col("params")["model_type"].alias("model"), entry.alias("e"))
    return pairs.select("model", F.col("e.key").alias("parameter"), F.col("e.value").alias("value")).distinct()


def sweep_runs(spark: SparkSession, values: DataFrame, sweeps: Mapping[str, tuple[str, str | None]] = SWEEPS,
               sets: Mapping[str, Sequence[str]] = SETS, baseline: Mapping[str, str] = BASELINE, n_runs: int = N_RUNS) -> DataFrame:
    """(root, sweep, position, parameter, value, model, embedding, normalize_targets, config, run, experiment_name).

    Position 0 is the baseline (parameter and value null), then come the sweep's values for its model, numbers
    in their order, other values after them by name.  ``config`` holds the model's own parameters."""
    members = [(s, m) for s, ms in sets.items() for m in ms]
    reach = expand_sets(spark, spark.createDataFrame(members or [("", "")], "parent string, child string"))
    alone = spark.createDataFrame([(s, s) for s in sweeps], "root string, name string")
    table = spark.createDataFrame([(s, p, m or baseline["model"]) for s, (p, m) in sweeps.items()], "name string, parameter string, base string")
    of_sweep = reach.unionByName(alone).distinct().join(table, "name").select("root", F.col("name").alias("sweep"), "parameter", "base")
    shared = F.col("parameter").isin(*SHARED)
    own = values.where(~shared).select(F.col("model").alias("base"), "parameter", "value")
    general = values.where(shared).select("parameter", "value").distinct()
    found = table.where(~shared).join(own, ["base", "parameter"]).select("name", "value").unionByName(
        table.where(shared).join(general, "parameter").select("name", "value")).distinct()
    order = Window.partitionBy("name").orderBy(F.col("value").try_cast("double").asc_nulls_last(), "value")
    found = found.select(F.col("name").alias("sweep"), "value", F.row_number().over(order).alias("position"))
    swept = of_sweep.join(found, "sweep")
    start = of_sweep.select("*", F.lit(None).cast("string").alias("value"), F.lit(0).alias("position"))
    rows = start.unionByName(swept)

    def chosen(name: str, otherwise):
        return F.when(F.col("value").isNotNull() & (F.col("parameter") == name), F.col("value")).otherwise(otherwise)

    rows = rows.select("root", "sweep", "position", F.when(F.col("value").isNotNull(), F.col("parameter")).alias("parameter"), "value",
                       chosen("model", F.col("base")).alias("model"), chosen("embedding", F.lit(baseline["embedding"])).alias("embedding"),
                       chosen("normalize_targets", F.lit(baseline["normalize_targets"])).alias("normalize_targets"))
    defaults = F.create_map(*[x for m, keys in MODEL_KEYS.items()
                              for x in (F.lit(m), F.create_map(*[y for k in keys for y in (F.lit(k), F.lit(baseline[k]))]))])
    config = F.transform_values(F.coalesce(defaults[F.col("model")], F.create_map().cast("map<string,string>")),
                                lambda k, v: F.when(k == F.col("parameter"), F.col("value")).otherwise(v))
    rows = rows.withColumn("config", config).withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(n_runs))))
    what = F.coalesce(F.concat("parameter", F.lit("="), "value"), F.lit("baseline"))
    return rows.withColumn("experiment_name", F.concat(what, F.lit("_model="), "model", F.lit("_emb="), "embedding", F.lit("_norm="),
                                                       "normalize_targets", F.lit("_run"), F.col("run").cast("string")))


def grid_with_values(dims: DataFrame, values: DataFrame, names: Sequence[str]) -> DataFrame:
    """The grid of the dimensions in ``dims`` (one row of arrays of distinct values, ``model`` among
    ``names``), each model with its own (parameter, value) rows and one without a sweep (nulls)."""
    from respan.operators.runs import grid_from_dimensions

    grid = grid_from_dimensions(dims, names)
    none = F.lit(None).cast("string")
    own = values.where(~F.col("parameter").isin(*SHARED))
    return grid.withColumn("parameter", none).withColumn("value", none).unionByName(grid.join(own, "model"))
