"""Experiment results, search spaces and sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from respan.operators.runs import metric, param


def comparison_table(runs: DataFrame) -> DataFrame:
    """Per model: runs, failed runs (kept as error rows), mean test mse / r2
    (``_avg`` fallback as logged) and mean wall-clock seconds."""
    mse = F.coalesce(metric("test_mse"), metric("test_mse_avg"))
    r2 = F.coalesce(metric("test_r2"), metric("test_r2_avg"))
    return runs.groupBy(param("model").alias("model")).agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.count(F.when(F.col("status") == "FAILED", 1)).alias("n_errors"),
        F.avg(mse).alias("mean_test_mse"), F.avg(r2).alias("mean_test_r2"),
        F.avg((F.col("end_time_ms") - F.col("start_time_ms")) / 1000.0).alias("mean_seconds"))
