"""What a task holds and hands on does not grow with the input."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from respan.operators import vectors as V
from respan.sources import scans as SC


class Batches:
    """Stands for a table of one Arrow batch: keeps what a function makes of it, batch by batch."""

    def __init__(self, batch):
        self.batch, self.columns = batch, batch.schema.names

    def mapInArrow(self, run, schema):  # noqa: N802
        return list(run(iter([self.batch])))


def test_texts_of_pairs_are_handed_on_together(tmp_path):
    names = [str(tmp_path / f"{i}.txt") for i in range(50)]
    for n in names:
        (tmp_path / n).write_text("text of " + n)
    batch = pa.RecordBatch.from_pydict({"model": [str(i) for i in range(50)], "doc": names, "csv": names[::-1]})
    out = SC._with_texts(Batches(batch), str(tmp_path))
    assert len(out) == 1 and out[0].column(3).to_pylist() == ["text of " + n for n in names]
    assert out[0].column(4).to_pylist() == ["text of " + n for n in names[::-1]]


def test_documents_are_encoded_in_small_parts():
    batch = pa.RecordBatch.from_pydict({"i": list(range(200))})
    parts = list(V._pieces(batch))
    assert max(p.num_rows for p in parts) <= V.ENCODED_ROWS and sum((p.column(0).to_pylist() for p in parts), []) == list(range(200))


@pytest.mark.parametrize("chunks", ["plain", "overlap", "precompute"])
def test_the_truncated_text_is_that_of_the_tokens(spark, chunks):
    """An encoder that fails on chunks shows the text that is tried next."""
    sizes = [1, 508, 509, 510, 511, 1100, 3000]
    docs = spark.createDataFrame([(n, " ".join(f"w{i}" for i in range(10, n + 10))) for n in sizes], "doc_id long, text string")

    def make():
        calls = {}

        def encode(texts):
            (text,) = texts
            calls[text] = calls.get(text, 0) + 1
            words = text.split(" ")
            if calls[text] == 1 and not (words[0] == "w10" and len(words) == 510):  # first as a chunk, then truncated
                raise RuntimeError(text)
            return [np.array([1.0, len(words)])]
        return encode

    out = {r.doc_id: r for r in V.encode_documents(docs.repartition(len(sizes) * 4, "doc_id"), make, chunks=chunks, batch=1).collect()}
    for n in sizes:
        if out[n].level == "truncated":
            assert round(out[n].vec[1] / out[n].vec[0]) == min(n, 510)


def test_edges_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(V, "TASK_EDGES", 100)
    edges = spark.range(5000).select((F.col("id") % 700).alias("doc"), F.lit(0).alias("layer"), (F.col("id") % 2).cast("int").alias("head"),
                                     (F.col("id") % 5).cast("int").alias("from_pos"), (F.col("id") % 3).cast("int").alias("to_pos"),
                                     F.lit(0.5).alias("weight"))
    first = spark.range(700).select(F.col("id").alias("doc"), F.lit("k").alias("keyword"), F.lit(0).alias("pos"))
    shuffles = V.keyword_edges(edges, first)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [doc" in shuffles and ", 50" in shuffles
    lengths = first.select("doc", F.lit(5).alias("n_tokens"))
    rows = V.keyword_layers(edges, first, lengths).collect()
    assert len(rows) == 700 and all(0 <= r.mean_from <= 0.5 for r in rows)
