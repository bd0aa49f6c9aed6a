"""Registered queries: scans, caches and sinks round-tripped through the shared
scratch folder (``spark.checkpoint.dir``), the skip-done anti join and its stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from respan import catalog as C
from respan.catalog import read_table, with_fixtures
from respan.operators import samples as S
from respan.operators.split import exact_split, split_sql
from respan.plans.evaluation_queries import _SAMPLES_SQL, _samples
from respan.operators.vectors import encode_documents
from respan.plans.registry import r6, register
from respan.plans.text_queries import _chunk_sql
from respan.plans.text_queries import _TFIDF_SQL
from respan.session import scratch_path, stored
from respan.sources import scans as SC


def _fx(body: str, *names: str, extra: str = "") -> str:
    if not names:
        return ("WITH " + extra.strip() + "\n" + body) if extra else body
    sql = with_fixtures("", *names)
    if extra:
        sql = sql.rstrip() + ",\n" + extra.strip() + "\n"
    return sql + body


def _tmp(spark, name: str) -> str:
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


@register("scan_documents", _fx("SELECT base_name, CAST(length(tpcm_text) AS BIGINT) AS n_chars FROM dsl_docs", "dsl_docs"))
def q_scan_documents(spark, sf):
    """Documents written one file per key, scanned back whole-file."""
    folder = _tmp(spark, "docs")
    SC.write_documents(C.dsl_docs(spark, sf), folder)
    d = SC.scan_documents(spark, folder, glob="*.txt", strip_sep="\n")
    return d.select("base_name", F.length("tpcm_text").cast("bigint").alias("n_chars"))


@register("scan_measurements", _fx(
    f"SELECT base_name, count(response_time) AS n, {r6('avg(response_time)', 'avg_resp_time')} FROM measurements "
    "WHERE CAST(substr(base_name, 7) AS BIGINT) % 3 <> 2 AND response_time IS NOT NULL GROUP BY base_name",
    "measurements"))
def q_scan_measurements(spark, sf):
    """Per-document CSVs with differing column order; files lacking the response
    column (every third user) are skipped; empty fields read back as nulls."""
    folder = _tmp(spark, "meas")
    m = C.measurements(spark, sf).withColumn("_g", F.expr("CAST(substr(base_name, 7) AS BIGINT) % 3"))
    for g, layout in [(0, "time_first"), (1, "response_first"), (2, "time_only")]:
        SC.write_measurements(m.where(F.col("_g") == g).drop("_g"), folder, layout)
    rows = S.drop_null_measurements(SC.scan_measurements(spark, folder))
    return rows.groupBy("base_name").agg(F.count("response_time").alias("n"),
                                         F.avg("response_time").alias("avg_resp_time"))


@register("split_cache_roundtrip", _fx(
    f"SELECT base_name, split, {r6('avg_resp_time', 'avg_resp_time')} FROM ({split_sql('samples', ['base_name'])}) WHERE split = 'val'",
    "dsl_docs", "measurements", extra=_SAMPLES_SQL))
def q_split_cache(spark, sf):
    """Splits saved partitioned by split; reloading one split prunes the others."""
    path = _tmp(spark, "splits")
    SC.save_split_cache(exact_split(_samples(spark, sf), ["base_name"]), path)
    return SC.load_split_cache(spark, path, "val").select("base_name", "split", "avg_resp_time")


@register("read_splits", _fx(
    f"SELECT split, count(*) AS n, {r6('sum(avg_resp_time)', 'sum_avg')} FROM ({split_sql('samples', ['base_name'])}) GROUP BY split",
    "dsl_docs", "measurements", extra=_SAMPLES_SQL))
def q_read_splits(spark, sf):
    """Train as CSV, val/test as Parquet in one folder, read back by extension."""
    base = _tmp(spark, "split-files")
    s = exact_split(_samples(spark, sf), ["base_name"]).select("base_name", "avg_resp_time", "split")
    SC.write_csv(s.where("split = 'train'").drop("split"), f"{base}/train.csv")
    for sp in ("val", "test"):
        s.where(F.col("split") == sp).drop("split").write.mode("overwrite").parquet(f"{base}/{sp}.parquet")
    r = SC.read_splits(spark, base)
    return r.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("avg_resp_time").cast("double")).alias("sum_avg"))


@register("csv_roundtrip", _fx(
    f"SELECT base_name, {r6('avg_resp_time', 'avg_resp_time')}, min_resp_time, max_resp_time, n_measurements FROM samples",
    "dsl_docs", "measurements", extra=_SAMPLES_SQL))
def q_csv_roundtrip(spark, sf):
    """Sample table through the CSV sink and back with an explicit schema."""
    path = _tmp(spark, "csv")
    s = _samples(spark, sf)
    SC.write_csv(s, path)
    return spark.read.option("header", True).schema(s.schema).csv(path)


@register("feature_checkpoint", _fx(
    "SELECT doc_id, term, " + r6("weight", "weight") + " FROM tfidf WHERE split = 'train'",
    extra=_TFIDF_SQL))
def q_feature_checkpoint(spark, sf):
    """TF-IDF features stored under features/embedding=tfidf/mode=summary;
    a second call loads instead of recomputing."""
    from respan.plans.text_queries import q_tfidf
    path = SC.feature_checkpoint_path(_tmp(spark, "ckpt"), "tfidf", "summary")
    SC.load_or_compute(spark, path, lambda: q_tfidf(spark, sf))
    return SC.load_or_compute(spark, path, lambda: (_ for _ in ()).throw(RuntimeError("recomputed")))


@register("trials_json", _fx(
    f"SELECT study, arg_min(number, (coalesce(value, 'inf'::DOUBLE), number)) AS best_number, "
    f"{r6('min(value)', 'best_value')} FROM trials GROUP BY study", "trials"))
def q_trials_json(spark, sf):
    """Best trial per study written as JSON lines and read back."""
    from respan.operators.runs import best_trial
    t = C.trials(spark, sf)
    b = best_trial(t.select("study", "number", "state", "value"), [])
    path = _tmp(spark, "json")
    SC.write_json(b.select("study", "best_number", F.col("best_objective").alias("best_value")), path)
    return spark.read.schema("study string, best_number bigint, best_value double").json(path)


@register("pending_documents", _fx(
    "SELECT base_name FROM dsl_docs WHERE base_name NOT IN (SELECT 'model_' || CAST(doc_id AS VARCHAR) FROM labels)",
    "dsl_docs"))
def q_pending(spark, sf):
    """Documents not processed yet (labelled documents stand for the done set)."""
    done = read_table(spark, sf, "labels").select(F.concat(F.lit("model_"), F.col("doc_id").cast("string")).alias("base_name"))
    return S.pending_documents(C.dsl_docs(spark, sf).select("base_name"), done)


@register("model_roundtrip", _fx("SELECT row_id, true AS agrees FROM features", "features"))
def q_model_roundtrip(spark, sf):
    """Fitted MLlib model saved, loaded and used for scoring."""
    from pyspark.ml.regression import LinearRegressionModel
    from respan.operators import models as MD
    f = C.features(spark, sf)
    m = MD.fit(f, "ridge", "x", "target")
    path = _tmp(spark, "model")
    m.write().overwrite().save(path)
    m2 = LinearRegressionModel.load(path)
    both = MD.score(m2, MD.score(m, f, "x", "before"), "x")
    return both.select("row_id", (F.col("yhat") == F.col("before")).alias("agrees"))


def _character_encoder(fails=None):
    """An encoder of 16 character counts, one call for a list of texts; texts for which ``fails``
    holds make the whole call fail, as a model's out-of-memory error would."""
    def make():
        import numpy as np

        def encode(texts):
            if fails is not None and any(fails(t) for t in texts):
                raise RuntimeError("a text of this call cannot be encoded")
            return [np.bincount(np.frombuffer(t.encode("utf-32-le"), np.uint32) % 16, minlength=16).astype(float) for t in texts]
        return encode
    return make


@register("embed_store", f"""WITH {_chunk_sql('plain').strip()}
SELECT doc_id, CAST(16 AS INTEGER) AS dim, CAST(strlen(text) AS BIGINT) AS file_size_bytes, NULL::VARCHAR AS error,
       CAST(len(t) AS BIGINT) AS token_count, CASE WHEN trim(text) = '' THEN 'blank' ELSE 'chunks' END AS level
FROM documents JOIN tok USING (doc_id)""")
def q_embed_store(spark, sf):
    """Documents encoded by a per-task Python encoder with metadata and error capture,
    appended to a Parquet store."""
    path = _tmp(spark, "store")
    encode_documents(read_table(spark, sf, "documents"), _character_encoder()).write.mode("append").parquet(path)
    return spark.read.parquet(path).select("doc_id", "dim", "file_size_bytes", "error", "token_count", "level")


@register("encode_ladder", f"""WITH {_chunk_sql('plain').strip()},
pt AS (SELECT doc_id, array_to_string(c, ' ') AS part FROM ct WHERE chunk_idx IS NOT NULL
       UNION ALL SELECT doc_id, text FROM documents JOIN nch USING (doc_id) WHERE n_chunks = 0 AND trim(text) <> ''),
f AS (SELECT d.doc_id, d.text, count(part) AS n_chunks, count(part) FILTER (WHERE length(part) % 3 = 0) AS n_failed
      FROM documents d LEFT JOIN pt USING (doc_id) GROUP BY d.doc_id, d.text),
s AS (SELECT f.*, CASE WHEN len(t) > 0 THEN array_to_string(t[1:510], ' ') ELSE text END AS short FROM f JOIN tok USING (doc_id)),
l AS (SELECT *, CASE WHEN trim(text) = '' THEN 'blank' WHEN n_failed < n_chunks THEN 'chunks' WHEN length(short) % 3 <> 0 THEN 'truncated'
                     WHEN length(text[1:1000]) % 3 <> 0 THEN 'first_1000' ELSE 'failed' END AS level FROM s)
SELECT doc_id, n_chunks, n_failed, level, level <> 'failed' AS has_vector, n_failed > 0 AS has_error FROM l""")
def q_encode_ladder(spark, sf):
    """An encoder that fails on texts whose length is a multiple of 3: chunks are isolated
    by bisection, then the truncated text and the first 1000 characters are tried."""
    out = encode_documents(read_table(spark, sf, "documents"), _character_encoder(lambda t: len(t) % 3 == 0))
    return out.select("doc_id", "n_chunks", "n_failed", "level", F.col("vec").isNotNull().alias("has_vector"),
                      F.col("error").isNotNull().alias("has_error"))


@register("collect_pairs", """
SELECT 'generated__' || doc_id AS model, status, CASE WHEN status = 'pair' THEN strlen(text) + 1 END::DOUBLE AS doc_bytes,
       CASE WHEN status = 'pair' THEN CASE WHEN doc_id % 10 = 3 THEN 'h,a' || chr(10) || doc_id || chr(10) ELSE 'h' || chr(10) || doc_id || ',1' || chr(10) END END AS csv_text
FROM (SELECT *, CASE doc_id % 10 WHEN 0 THEN 'no document' WHEN 1 THEN 'no measurements' WHEN 2 THEN 'header only' ELSE 'pair' END AS status FROM documents)""")
def q_collect_pairs(spark, sf):
    """Nested folders are written (some without a document, without measurements, with a header only, with
    two CSVs), searched in tasks, and the pairs copied and read back by their manifest."""
    from respan.sources.files import write_text_files
    d = read_table(spark, sf, "documents").select(F.col("doc_id").alias("i"), "text")
    kind, folder = F.col("i") % 10, F.concat(F.lit("generated__"), F.col("i").cast("string"), F.lit(".tpcm"))
    i = F.col("i").cast("string")
    docs = d.where(kind != 0).select(F.concat(folder, F.lit("/"), folder).alias("file"), F.lit(0).alias("pos"), F.col("text").alias("line"))
    plain = d.where(~kind.isin(1, 2)).select(F.concat(folder, F.lit("/sub/Usage_Scenario_b.csv")).alias("file"),
                                             F.posexplode(F.array(F.lit("h"), F.concat(i, F.lit(",1")))).alias("pos", "line"))
    more = d.where(kind == 3).select(F.concat(folder, F.lit("/a/Usage_Scenario_a.csv")).alias("file"),
                                     F.posexplode(F.array(F.lit("h,a"), i)).alias("pos", "line"))
    header = d.where(kind == 2).select(F.concat(folder, F.lit("/Usage_Scenario_h.csv")).alias("file"), F.lit(0).alias("pos"), F.lit("h").alias("line"))
    other = d.where(kind == 1).select(F.concat(folder, F.lit("/notes.csv")).alias("file"), F.lit(0).alias("pos"), F.lit("h").alias("line"))
    root, out = _tmp(spark, "PCMs"), _tmp(spark, "pairs")
    write_text_files(docs.unionByName(plain).unionByName(more).unionByName(header).unionByName(other), root, "file", ["pos"], "line")
    found = stored(SC.find_pairs(spark, root), "pairs-found")  # read twice; the folders are searched once
    SC.stage_pairs(found.where("status = 'pair'"), out)
    both = SC.read_pairs(spark, out).select("model", F.octet_length("doc_text").cast("double").alias("doc_bytes"), "csv_text")
    return found.select("model", "status").join(both, "model", "left")


@register("stream_pending", _fx(
    "SELECT 'model_' || CAST(doc_id AS VARCHAR) AS base_name, CAST(len(t) AS INTEGER) AS token_count FROM tok",
    extra="tok AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') AS t FROM documents)"))
def q_stream_pending(spark, sf):
    """J3 as a stream: availableNow pass over the document folder; a second pass after
    no new files adds nothing."""
    from respan.streaming.pending import embed_new_documents
    folder, out, ck = _tmp(spark, "sdocs"), _tmp(spark, "sout"), _tmp(spark, "sck")
    SC.write_documents(C.dsl_docs(spark, sf), folder)
    embed_new_documents(spark, folder, out, ck)
    embed_new_documents(spark, folder, out, ck)
    return spark.read.parquet(out).select("base_name", F.col("token_count").cast("int").alias("token_count"))


@register("scan_runs_partitioned", _fx(
    f"SELECT run_id, {r6('val_mse_avg', 'val_mse_avg')} FROM runs_wide WHERE model_type = 'rf' "
    "ORDER BY val_mse_avg DESC NULLS LAST, run_id", "runs_wide"))
def q_scan_runs_partitioned(spark, sf):
    """S9 over the stored run table: the model filter prunes partitions at the scan."""
    from respan.operators.runs import metric, scan_runs
    path = _tmp(spark, "runs")
    SC.write_run_table(C.runs(spark, sf), path)
    rf = SC.read_run_table(spark, path, "rf")
    return scan_runs(rf, None, "val_mse_avg").select("run_id", metric("val_mse_avg").alias("val_mse_avg"))
