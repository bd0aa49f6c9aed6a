"""The pipeline's stages on the smallest tables, each against its own input."""

import hashlib

import corpus_pipeline as P
from tests.conftest import SF_SMALL
from tests.llm import brute


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    kept, seen = docs, {}
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, kept, SF_SMALL)
        assert out.columns == docs.columns, name
        before, kept = kept, spark.createDataFrame(out.collect(), docs.schema)
        seen[name] = ({r.doc_id: r.text for r in before.collect()}, {r.doc_id: r.text for r in kept.collect()})
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").collect()}
    before, after = seen["toxicity"]
    assert sum(labels.get(d) == 0 for d in before) - sum(labels.get(d) == 0 for d in after) <= 3
    before, after = seen["simhash"]
    groups = brute.simhash_components(list(before.items()))
    assert set(after) == {c for _, c in groups.values()}
    before, after = seen["decontamination"]
    items = [r.text.split() for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]

    def holds(text):
        line = f" {' '.join(text.split())} "
        return any(f" {' '.join(w[1:])} " in line for w in items if len(w) > 13)

    assert not any(holds(t) for t in after.values()) and all(holds(before[d]) for d in before if d not in after)
    before, after = seen["pii"]
    assert set(before) == set(after)
    for d, t in before.items():
        assert (t == after[d]) or brute.personal_data(t) or "[ACCOUNT]" in after[d] or "[LOGIN]" in after[d]
        assert not any(k == "email" for k, _, _ in brute.personal_data(after[d]))
    pieces = P.STAGES[-1][1](spark, kept, SF_SMALL).toPandas()
    assert set(pieces.doc_id) == set(after) and hashlib.sha256(b"").digest_size == 32
    assert pieces.groupby("sequence_id").length.sum().max() <= 2048
