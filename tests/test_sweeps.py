"""Nested sweep sets against a plain expansion."""

from respan.operators import sweeps as S


def plain(name):
    if name in S.SWEEPS:
        return [name]
    return list(dict.fromkeys(x for m in S.SETS[name] for x in plain(m)))


def test_sets_expand_like_the_plain_recursion(spark):
    members = spark.createDataFrame([(s, m) for s, ms in S.SETS.items() for m in ms], "parent string, child string")
    reach = {(r.root, r.name) for r in S.expand_sets(spark, members).collect()}
    for s in S.SETS:
        assert {n for root, n in reach if root == s and n in S.SWEEPS} == set(plain(s))
    assert len(plain("complete-analysis")) == len(S.SWEEPS)


def test_runs_of_a_sweep(spark):
    values = spark.createDataFrame([("ridge", "alpha", "10"), ("ridge", "alpha", "2"), ("ridge", "alpha", "auto"), ("lasso", "alpha", "0.5"),
                                    ("svm", "C", "1"), ("rf", "embedding", "bert"), ("svm", "embedding", "bert")],
                                   "model string, parameter string, value string")
    rows = S.sweep_runs(spark, values).collect()
    assert len(rows) == len({(r.root, r.sweep, r.position, r.run) for r in rows})
    ridge = sorted((r for r in rows if r.root == "linear-analysis" and r.sweep == "linear-ridge" and r.run == 1), key=lambda r: r.position)
    assert [(r.position, r.value, r.model, r.config) for r in ridge] == [
        (0, None, "ridge", {"alpha": "1.0"}), (1, "2", "ridge", {"alpha": "2"}), (2, "10", "ridge", {"alpha": "10"}),
        (3, "auto", "ridge", {"alpha": "auto"})]
    assert ridge[0].experiment_name == "baseline_model=ridge_emb=tfidf_norm=false_run1"
    bert = [r for r in rows if r.root == r.sweep == "embedding-impact" and r.value == "bert"]
    assert [r.run for r in sorted(bert, key=lambda r: r.run)] == [1, 2, 3] and {r.embedding for r in bert} == {"bert"}
    assert {r.config["kernel"] for r in bert} == {"rbf"} and {r.model for r in bert} == {"svm"}
    assert not [r for r in rows if r.sweep == "nn-epochs" and r.position]  # no values for torch: its baseline only
