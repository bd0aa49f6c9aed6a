"""Published mean-predictor baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Mean-predictor baselines published by the reference, per
# (metric, normalized targets).  Order: metric, normalized, value.
PUBLISHED_BASELINES = [
    ("test_mse_avg", True, 1.506065), ("test_mae_avg", True, 0.191592), ("test_r2_avg", True, -0.000354),
    ("test_rmse_avg", True, 1.227218), ("val_mse_avg", True, 0.292405), ("val_mae_avg", True, 0.126550),
    ("val_r2_avg", True, -0.006406), ("val_rmse_avg", True, 0.540745),
    ("test_mse_avg", False, 44.160929), ("test_mae_avg", False, 1.037466), ("test_r2_avg", False, -0.000354),
    ("test_rmse_avg", False, 6.645369), ("val_mse_avg", False, 8.573906), ("val_mae_avg", False, 0.685265),
    ("val_r2_avg", False, -0.006406), ("val_rmse_avg", False, 2.928123),
]


def baseline_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PUBLISHED_BASELINES, "metric string, normalized boolean, baseline double")


def attach_baseline(spark: SparkSession, stats: DataFrame, metric: str = "metric",
                    normalized: str = "normalize_targets") -> DataFrame:
    """Constant baseline beside every (metric, normalisation) statistic.  The
    baseline table has 16 fixed rows, so broadcasting it is safe at any scale."""
    b = F.broadcast(baseline_table(spark))
    return stats.join(b, (stats[metric] == b["metric"]) & (stats[normalized] == b["normalized"]), "inner") \
        .drop(b["metric"]).drop(b["normalized"])
