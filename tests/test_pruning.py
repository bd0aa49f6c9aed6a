"""Median pruning against running medians of a sorted list."""

import bisect

import numpy as np
import pandas as pd
import pytest

from respan.operators import pruning


def brute(rows, n_startup, n_warmup):
    """(study, number) -> (prune_step, last_step)."""
    out = {}
    frame = pd.DataFrame(rows, columns=["study", "number", "step", "value"])
    for (study, step), g in frame.groupby(["study", "step"]):
        seen: list[float] = []
        for number, same in sorted(g.groupby("number"), key=lambda x: x[0]):
            key = (study, number)
            flag, last = out.get(key, (None, -1))
            m = len(seen)
            if m and m >= n_startup and step >= n_warmup:
                median = (seen[(m - 1) // 2] + seen[m // 2]) / 2
                if any(v > median for v in same.value) and (flag is None or step < flag):
                    flag = step
            out[key] = (flag, max(last, step))
            for v in same.value:
                if not np.isnan(v):
                    bisect.insort(seen, v)
    return out


def found(spark, rows, n_startup, n_warmup):
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["study", "number", "step", "value"]))
    out = pruning.median_prune(df, n_startup, n_warmup).toPandas()
    return {(r.study, r.number): (None if pd.isna(r.prune_step) else int(r.prune_step), r.last_step) for r in out.itertuples()}


def test_earlier_order():
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 50, 257):
        group = np.sort(rng.integers(0, 3, n))
        order, value = rng.integers(0, n, n), rng.integers(0, 9, n).astype(float)
        seen, less, below, above = pruning.earlier_order(group, order, value)
        for i in range(n):
            v = value[(order < order[i]) & (group == group[i])]
            assert (seen[i], less[i]) == (len(v), (v < value[i]).sum())
            assert below[i] == v[v < value[i]].max() if (v < value[i]).any() else np.isnan(below[i])
            assert above[i] == v[v >= value[i]].min() if (v >= value[i]).any() else np.isnan(above[i])


@pytest.mark.parametrize("start", [(0, 0), (10, 2)])
def test_small_studies_with_ties_gaps_and_missing_values(spark, start, monkeypatch):
    monkeypatch.setattr(pruning, "HELD_ROWS", 40)
    rng = np.random.default_rng(6)
    rows = []
    for study, trials in (("a", 90), ("b", 7), ("c", 300)):
        for number in rng.permutation(trials).tolist():
            for step in range(int(rng.integers(1, 5))):
                value = [float(rng.integers(0, 6)), float(rng.normal()), 5.0, float("nan")][int(rng.choice(4, p=[0.4, 0.3, 0.25, 0.05]))]
                rows.append((study, number, step, value))
    rows += [("a", 4, 0, 1.5), ("a", 4, 0, 2.5)]  # a number that comes more than once
    assert found(spark, rows, *start) == brute(rows, *start)


def test_one_study_of_many_trials(spark):
    rng = np.random.default_rng(8)
    n = 100_000
    value = np.where(rng.random(n) < 0.35, 0.5, rng.random(n) + 0.5 * (np.arange(n) % 3 == 0))
    rows = list(zip(["s"] * n, rng.permutation(n).tolist(), [1] * n, value.tolist(), strict=True))
    assert found(spark, rows, 5, 0) == brute(rows, 5, 0)


def test_rows_of_many_groups_keep_their_order():
    """Groups, orders and values with ties against plain counting; each row is sorted once, not once a halving."""
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 17, 200):
        group, order, value = np.sort(rng.integers(0, 5, n)), rng.integers(0, 40, n), rng.integers(0, 30, n) * 1.0
        seen, less, below, above = pruning.earlier_order(group, order, value)
        for i in range(n):
            earlier = value[(group == group[i]) & (order < order[i])]
            low, high = earlier[earlier < value[i]], earlier[earlier >= value[i]]
            assert (seen[i], less[i]) == (len(earlier), len(low))
            assert (np.isnan(below[i]) and not len(low)) or below[i] == low.max()
            assert (np.isnan(above[i]) and not len(high)) or above[i] == high.min()


def test_the_halving_sorts_once(monkeypatch):
    rng, calls, lexsort = np.random.default_rng(6), [], np.lexsort
    monkeypatch.setattr(pruning.np, "lexsort", lambda keys: calls.append(1) or lexsort(keys))
    pruning.earlier_order(np.zeros(5000, np.int64), np.arange(5000), rng.random(5000))
    assert len(calls) <= 2
