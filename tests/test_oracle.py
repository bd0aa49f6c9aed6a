"""Every registered query with an SQL twin must match DuckDB (row count, columns,
values) - the same gate the driver applies; run on the smallest scale factor."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL
from tests.oracle_harness import compare

FAST = ["pair_documents", "split_70_15_15", "mean_baseline_metrics", "regression_metrics", "multi_target_metrics",
        "error_stats", "error_histogram", "run_summary_sets", "parse_run_name", "whitelist_runs",
        "param_summary_stats", "best_so_far", "median_prune", "tfidf", "chunk_plain", "pool_mean",
        "token_importance", "learning_curve", "stratified_folds", "cv_summary", "scan_measurements"]


@pytest.mark.parametrize("name", FAST)
def test_matches_duckdb(spark, name):
    r = compare(spark, name, SF_SMALL)
    assert r.get("ok"), r


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 3 and set(df.columns) >= {"split", "mse", "mae", "r2", "rmse"}


def test_every_sql_twin_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
