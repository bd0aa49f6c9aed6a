"""Rows with nearly as many groups as rows are shuffled to their key first, not grouped by input split."""

import numpy as np

from respan import catalog as C
from respan.operators import metrics as M
from respan.operators import text as T
from respan.functions.hashing import GOLDEN32, MIX32_MULT, MOD32


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_move_and_not_their_terms(spark):
    d = spark.createDataFrame([(1, "b a b"), (2, "aa bb aa"), (2, "aa")], "doc_id long, text string")
    tf = T.term_counts(d)
    assert plan(tf).count("Exchange ") == 1 and "Generate" in plan(tf).split("Exchange ")[0]
    assert {(r.doc_id, r.term): r.tf for r in tf.collect()} == {(2, "aa"): 3, (2, "bb"): 1, (2, "aa bb"): 1, (2, "bb aa"): 1}


def test_aligned_rows_meet_before_the_pivot(spark):
    rows = [(i, m, float(i), i + k / 10) for i in range(6) for k, m in enumerate(["a", "b", "c", "x"]) if (i, m) != (3, "c")]
    d = spark.createDataFrame(rows, "row_id long, model string, y double, yhat double")
    out = M.align_predictions(d, ["a", "b", "c"])
    assert "REPARTITION_BY_COL" in plan(out)
    got = {r.row_id: (r.actual, r.a, r.b, r.c) for r in out.collect()}
    assert got == {i: (float(i), float(i), i + 0.1, None) for i in range(6)}


def test_history_rows_meet_by_run(spark, tmp_path):
    spark.createDataFrame([(1, 3, 1, 10.0), (1, 3, 1, 5.0), (2, 4, 2, 7.0)],
                          "l_orderkey long, l_partkey long, l_linenumber int, l_extendedprice double").write.parquet(str(tmp_path / "lineitem.parquet"))
    h = C.metric_history(spark, str(tmp_path))
    assert plan(h).count("Exchange ") == 1 and "REPARTITION_BY_COL" in plan(h)
    assert sorted(map(tuple, h.collect())) == [("r1", "train_loss", 1, 0.005), ("r2", "val_loss", 2, 0.007)]


def test_bootstrap_weights_of_wrapping_integers(spark):
    """Plain Python integers against the tasks' 32-bit arithmetic, keys below zero and above 2**32 included."""
    def mix(x):
        for step in range(3):
            x ^= x >> 16
            if step < 2:
                x = x * MIX32_MULT % MOD32
        return x
    import pandas as pd
    keys = [0, 1, -1, -5, MOD32 - 1, MOD32, MOD32 + 7, 2 ** 62] + list(range(100, 700))
    frame = pd.DataFrame({"row_id": keys, "y": 1.0, "yhat": 0.0})
    (got,) = M._poisson_partial_sums([], "row_id", "y", "yhat", 50, 42)(iter([frame]))
    want = [sum(sum(mix((mix((k % MOD32 + 42 * GOLDEN32 % MOD32) % MOD32) + r * GOLDEN32) % MOD32) / MOD32 >= c for c in M.POISSON1_CDF)
                for k in keys) for r in range(50)]
    assert np.array_equal(got["sw"], want)
