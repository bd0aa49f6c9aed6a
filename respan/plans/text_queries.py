"""Registered queries: text features (TF-IDF, chunks, keywords) and document vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from respan import catalog as C
from respan.catalog import read_table, with_fixtures
from respan.operators import svd
from respan.operators import text as T
from respan.operators import vectors as V
from respan.operators.split import exact_split, split_sql
from respan.plans.registry import r6, register


def _fx(body: str, *names: str, extra: str = "") -> str:
    if not names:
        return ("WITH " + extra.strip() + "\n" + body) if extra else body
    sql = with_fixtures("", *names)
    if extra:
        sql = sql.rstrip() + ",\n" + extra.strip() + "\n"
    return sql + body


_PAT = r"[\p{L}\p{N}_]{2,}"
_TOK_SQL = f"tok AS (SELECT doc_id, regexp_extract_all(lower(text), '{_PAT}') AS t FROM documents)"
_TERMS_EXPR = ("list_concat(t, CASE WHEN len(t) >= 2 THEN list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) "
               "ELSE []::VARCHAR[] END)")
_TFIDF_SQL = f"""
sp AS ({split_sql('documents', ['doc_id'])}),
tok AS (SELECT doc_id, split, regexp_extract_all(lower(text), '{_PAT}') AS t FROM sp),
terms AS (SELECT doc_id, split, unnest({_TERMS_EXPR}) AS term FROM tok),
tf AS (SELECT doc_id, split, term, count(*) AS tf FROM terms GROUP BY ALL),
dfq AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf WHERE split = 'train' GROUP BY term HAVING count(*) >= 2),
voc AS (SELECT term, df, cf FROM dfq),
ntr AS (SELECT count(*) AS n FROM sp WHERE split = 'train'),
model AS (SELECT term, df, ln((1.0 + n) / (1.0 + df)) + 1.0 AS idf FROM voc, ntr),
wt AS (SELECT doc_id, split, term, (1.0 + ln(tf)) * idf AS w FROM tf JOIN model USING (term)),
tfidf AS (SELECT doc_id, split, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM wt)
"""


def _docs(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", "text")


def _split_docs(spark, sf):
    return exact_split(_docs(spark, sf), ["doc_id"])


def _model(spark, sf):
    d = _split_docs(spark, sf)
    return T.fit_tfidf(d.where(F.col("split") == "train"))


@register("tokenize", _fx("SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct, "
                          "md5(array_to_string(t, ' ')) AS tokens_md5 FROM tok",
                          extra=_TOK_SQL))
def q_tokenize(spark, sf):
    t = _docs(spark, sf).select("doc_id", T.tokenize(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"),
                    F.size(F.array_distinct("t")).cast("bigint").alias("n_distinct"),
                    F.md5(F.concat_ws(" ", "t").cast("binary")).alias("tokens_md5"))


@register("ngrams", _fx(f"SELECT doc_id, CAST(len({_TERMS_EXPR}) AS BIGINT) AS n_terms, "
                       f"md5(array_to_string({_TERMS_EXPR}, '|')) AS terms_md5 FROM tok", extra=_TOK_SQL))
def q_ngrams(spark, sf):
    t = _docs(spark, sf).select("doc_id", T.tokenize(F.col("text")).alias("t"))
    t = t.select("doc_id", T.with_ngrams(F.col("t")).alias("g"))
    return t.select("doc_id", F.size("g").cast("bigint").alias("n_terms"),
                    F.md5(F.concat_ws("|", "g").cast("binary")).alias("terms_md5"))


@register("document_frequency", _fx("SELECT term, df, CAST(cf AS BIGINT) AS cf FROM dfq", extra=_TFIDF_SQL))
def q_document_frequency(spark, sf):
    d = _split_docs(spark, sf).where(F.col("split") == "train")
    return T.document_frequency(T.term_counts(d))


@register("vocabulary", _fx("SELECT term, df, CAST(cf AS BIGINT) AS cf FROM voc ORDER BY cf DESC, term ASC LIMIT 10000", extra=_TFIDF_SQL))
def q_vocabulary(spark, sf):
    d = _split_docs(spark, sf).where(F.col("split") == "train")
    return T.vocabulary(T.document_frequency(T.term_counts(d)))


@register("idf_smooth", _fx(f"SELECT term, df, {r6('idf', 'idf')} FROM model", extra=_TFIDF_SQL))
def q_idf(spark, sf):
    return _model(spark, sf)


@register("tf_sublinear", _fx(
    f"SELECT doc_id, term, tf, {r6('1.0 + ln(tf)', 'tf_sub')} FROM tf WHERE split = 'train' AND term IN (SELECT term FROM voc)",
    extra=_TFIDF_SQL))
def q_tf_sublinear(spark, sf):
    d = _split_docs(spark, sf).where(F.col("split") == "train")
    tf = T.term_counts(d).join(_model(spark, sf).select("term"), "term", "left_semi")
    return tf.select("doc_id", "term", "tf", (F.lit(1.0) + F.log(F.col("tf").cast("double"))).alias("tf_sub"))


def _terms(spark, sf):
    return T.packed_terms(_split_docs(spark, sf), F.col("split") == "train", keep=["split"])


@register("tfidf", _fx(f"SELECT doc_id, term, {r6('weight', 'weight')} FROM tfidf WHERE split = 'train'", extra=_TFIDF_SQL))
def q_tfidf(spark, sf):
    return _terms(spark, sf).weights(["doc_id", "split"], train=True).drop("split")


@register("tfidf_transform", _fx(
    f"SELECT doc_id, term, {r6('weight', 'weight')} FROM tfidf WHERE split <> 'train'", extra=_TFIDF_SQL))
def q_tfidf_transform(spark, sf):
    return _terms(spark, sf).weights(["doc_id", "split"], train=False).where(F.col("split") != "train").drop("split")


@register("tfidf_svd", _fx(
    f"""SELECT (SELECT n FROM ntr) AS n_docs, count(*) AS n_terms, least(1000, least((SELECT n FROM ntr), count(*)) - 1) AS components_allowed,
           {r6('sum(ss)', 'squared_weight')}, {r6('(sum(ss) - sum(s * s) / (SELECT n FROM ntr)) / (SELECT n FROM ntr)', 'total_variance')},
           true AS orthogonal, true AS projection_has_singular_lengths, true AS captures_its_share, true AS new_rows_stay_within
        FROM (SELECT term, sum(weight) AS s, sum(weight * weight) AS ss FROM tfidf WHERE split = 'train' GROUP BY term)""", extra=_TFIDF_SQL))
def q_tfidf_svd(spark, sf):
    """Fitted on all training weights, every other document projected.  SQL has no solver, so
    beside the sums the row holds what fixes a truncated SVD: orthonormal right vectors, columns of
    the projection as long as the singular values, at least the share of squared weight that k of
    min(n, d) leading directions have, and no new row longer than its own weights (all of length 1)."""
    terms, keep = _terms(spark, sf), ["doc_id", "split"]
    m = svd.fit_svd(terms.weights(keep, train=True).drop("split"))
    square = F.transform("svd", lambda x: x * x)
    lengths = m.projection.select(F.posexplode(square).alias("c", "v")).groupBy("c").agg(F.sum("v").alias("v")).toPandas()
    found = lengths.sort_values("c")["v"].to_numpy()
    allowed = min(svd.N_COMPONENTS, min(m.n_rows, m.n_columns) - 1)
    least = allowed / min(m.n_rows, m.n_columns) * m.squared_weight
    longest = (m.transform(terms.weights(keep, train=False).where(F.col("split") != "train").drop("split"))
               .select(F.aggregate(square, F.lit(0.0), lambda a, v: a + v).alias("v")).agg(F.max("v")).first()[0])
    row = (m.n_rows, m.n_columns, allowed, round(m.squared_weight, 6), round(m.total_variance, 6), m.orthogonality_error < 1e-9,
           bool(len(found) == m.k and np.allclose(found, m.singular_values ** 2, rtol=1e-6, atol=1e-9)),
           bool(least * (1 - 1e-6) <= (m.singular_values ** 2).sum() <= m.squared_weight * (1 + 1e-9)), longest <= 1 + 1e-9)
    return spark.createDataFrame([row], "n_docs long, n_terms long, components_allowed long, squared_weight double, total_variance double, "
                                 "orthogonal boolean, projection_has_singular_lengths boolean, captures_its_share boolean, "
                                 "new_rows_stay_within boolean")


def _chunk_sql(mode: str) -> str:
    if mode == "plain":
        w = s = 458
        cond, short = "len(t) + 2 > 510", 510
    elif mode == "overlap":
        w, s, cond, short = 510, 460, "len(t) > 510", 510
    else:
        w, s, cond, short = 1024, 924, "len(t) > 1024", 1024
    chunks = f"list_transform(range(0, len(t), {s}), lambda st: list_slice(t, st + 1, st + {w}))"
    return _TOK_SQL + f""",
ch AS (SELECT doc_id, CASE WHEN len(t) = 0 THEN []::VARCHAR[][] WHEN {cond} THEN {chunks} ELSE [list_slice(t, 1, {short})] END AS chunks FROM tok),
ct AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS chunk_idx, c FROM (SELECT doc_id, unnest(chunks) AS c, generate_subscripts(chunks, 1) AS i FROM ch
       UNION ALL SELECT doc_id, NULL, NULL FROM ch WHERE len(chunks) = 0)),
nch AS (SELECT doc_id, CAST(len(chunks) AS INTEGER) AS n_chunks FROM ch)
"""


def _chunk_out(df):
    return df.select("doc_id", "chunk_idx", F.coalesce(F.size("tokens"), F.lit(0)).cast("bigint").alias("n_tokens"),
                     F.md5(F.concat_ws(" ", "tokens").cast("binary")).alias("tokens_md5"))


_CHUNK_SELECT = ("SELECT doc_id, chunk_idx, CAST(coalesce(len(c), 0) AS BIGINT) AS n_tokens, "
                 "md5(coalesce(array_to_string(c, ' '), '')) AS tokens_md5 FROM ct")


@register("chunk_plain", _fx(_CHUNK_SELECT, extra=_chunk_sql("plain")))
def q_chunk_plain(spark, sf):
    return _chunk_out(T.chunk_table(_docs(spark, sf), "plain"))


@register("chunk_overlap", _fx(_CHUNK_SELECT, extra=_chunk_sql("overlap")))
def q_chunk_overlap(spark, sf):
    return _chunk_out(T.chunk_table(_docs(spark, sf), "overlap"))


@register("chunk_precompute", _fx(_CHUNK_SELECT, extra=_chunk_sql("precompute")))
def q_chunk_precompute(spark, sf):
    return _chunk_out(T.chunk_table(_docs(spark, sf), "precompute"))


_TOKENS_SQL = """
toks AS (SELECT doc_id AS doc, CAST(i - 1 AS INTEGER) AS pos, token FROM (
           SELECT doc_id, unnest(a) AS token, generate_subscripts(a, 1) AS i FROM (
             SELECT doc_id, regexp_split_to_array(lower(text), '\\s+') AS a FROM documents))),
hits AS (SELECT doc, keyword, pos FROM toks, (SELECT unnest([""" + ", ".join(f"'{k.lower()}'" for k in T.DSL_KEYWORDS) + """]) AS keyword)
         WHERE contains(token, keyword))
"""


@register("keyword_positions", _fx(
    """SELECT doc AS doc_id, keyword, count(*) AS occurrences, CAST(min(pos) AS BIGINT) AS first_pos,
              md5(string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos)) AS positions_md5 FROM hits GROUP BY doc, keyword""",
    extra=_TOKENS_SQL))
def q_keywords(spark, sf):
    k = T.keyword_positions(_docs(spark, sf))
    return k.select("doc_id", "keyword", "occurrences", F.col("first_pos").cast("bigint").alias("first_pos"),
                    F.md5(F.concat_ws(",", F.transform("positions", lambda p: p.cast("string"))).cast("binary")).alias("positions_md5"))


@register("document_metadata", _fx(
    "SELECT doc_id, CAST(len(t) AS BIGINT) AS token_count, CAST(strlen(text) AS BIGINT) AS file_size_bytes, "
    "trim(text) = '' AS is_blank FROM (SELECT doc_id, text, regexp_extract_all(lower(text), "
    f"'{_PAT}') AS t FROM documents)"))
def q_metadata(spark, sf):
    m = T.document_metadata(_docs(spark, sf))
    return m.select("doc_id", F.col("token_count").cast("bigint"), F.col("file_size_bytes").cast("bigint"), "is_blank")


@register("blank_documents", _fx(
    f"""SELECT doc_id, trim(text) = '' AS is_blank, {r6('1.0', 'bert_norm')}, trim(text) = '' AS bert_is_space,
           {r6("CASE WHEN trim(text) = '' THEN 0.0 ELSE 1.0 END", 'llama_norm')} FROM (SELECT doc_id,
           CASE WHEN doc_id % 7 = 0 THEN '  ' ELSE text END AS text FROM documents)"""))
def q_blank(spark, sf):
    """Blank documents are encoded as one space (BERT path) or become a zero vector (LLaMA
    path); every seventh text is made blank.  The encoder counts characters, so a space is a unit vector."""
    d = _docs(spark, sf).withColumn("text", F.when(F.col("doc_id") % 7 == 0, "  ").otherwise(F.col("text")))

    def make():
        return lambda texts: [np.bincount(np.frombuffer(t.encode("utf-32-le"), np.uint32) % 16, minlength=16) for t in texts]

    def norm(c):
        return F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, v: a + v * v))
    bert = V.encode_documents(d, make).select("doc_id", (F.col("level") == "blank").alias("is_blank"), norm("vec").alias("bert_norm"),
                                              (F.get("vec", F.lit(0)) == 1.0).alias("bert_is_space"))
    llama = V.encode_documents(d, make, blank="zero", dim=16, chunks="precompute").select("doc_id", norm("vec").alias("llama_norm"))
    return bert.join(llama, "doc_id")


# ------------------------------------------------------------------ vectors

_HASH_SQL = _chunk_sql("plain") + """,
tk AS (SELECT doc_id, chunk_idx, unnest(c) AS token FROM ct),
hv AS (SELECT doc_id, chunk_idx, CAST(CAST(('0x' || substr(md5(token), 1, 4)) AS INTEGER) % 64 AS INTEGER) AS dim,
              CASE WHEN CAST(('0x' || substr(md5(token), 5, 1)) AS INTEGER) % 2 = 0 THEN 1.0 ELSE -1.0 END AS s FROM tk),
cv0 AS (SELECT doc_id, chunk_idx, dim, sum(s) AS value FROM hv GROUP BY ALL HAVING sum(s) <> 0),
cv1 AS (SELECT doc_id, chunk_idx, dim, value / sqrt(sum(value * value) OVER (PARTITION BY doc_id, chunk_idx)) AS value FROM cv0),
cv AS (SELECT * FROM cv1 UNION ALL SELECT doc_id, coalesce(chunk_idx, 0), 0, 0.0 FROM ct
       WHERE (doc_id, coalesce(chunk_idx, -1)) NOT IN (SELECT (doc_id, chunk_idx) FROM cv0)),
nl AS (SELECT doc_id, greatest(n_chunks - 1, 0) AS last FROM nch)
"""


def _pool_sql(how: str) -> str:
    if how == "mean":
        w, d = "1.0", "CAST(last + 1 AS DOUBLE)"
    elif how == "first_last":
        w = "CASE WHEN chunk_idx = 0 OR chunk_idx = last THEN 1.0 ELSE 0.0 END"
        d = "CASE WHEN last = 0 THEN 1.0 ELSE 2.0 END"
    else:
        w = "CASE WHEN chunk_idx = 0 THEN 1.5 WHEN chunk_idx = last THEN 1.3 ELSE 1.0 END"
        d = "CASE WHEN last = 0 THEN 1.5 ELSE 1.5 + 1.3 + CAST(last - 1 AS DOUBLE) END"
    pooled = f"SELECT doc_id, dim, sum(value * ({w}) / ({d})) AS value FROM cv JOIN nl USING (doc_id) GROUP BY doc_id, dim"
    unit = "CASE WHEN sum(value * value) OVER p > 0 THEN value / sqrt(sum(value * value) OVER p) ELSE value END"
    # a zero vector is one row (dimension 0)
    return (f"SELECT doc_id, dim, {r6(unit, 'value')} FROM (SELECT *, max(abs(value)) OVER (PARTITION BY doc_id) AS top, "
            f"min(dim) OVER (PARTITION BY doc_id) AS d0 FROM ({pooled})) "
            "WHERE abs(value) > 1e-12 OR (top <= 1e-12 AND dim = d0) WINDOW p AS (PARTITION BY doc_id)")


def _chunk_vectors(spark, sf):
    return V.hash_encode_chunks(T.chunk_table(_docs(spark, sf), "plain"))


@register("encode_documents", _fx(f"SELECT doc_id, chunk_idx, dim, {r6('value', 'value')} FROM cv", extra=_HASH_SQL))
def q_encode(spark, sf):
    return _chunk_vectors(spark, sf).drop("n_chunks")


@register("pool_mean", _fx(_pool_sql("mean"), extra=_HASH_SQL))
def q_pool_mean(spark, sf):
    return V.pool_chunks(_chunk_vectors(spark, sf), "mean")


@register("pool_first_last", _fx(_pool_sql("first_last"), extra=_HASH_SQL))
def q_pool_first_last(spark, sf):
    return V.pool_chunks(_chunk_vectors(spark, sf), "first_last")


@register("pool_weighted", _fx(_pool_sql("weighted"), extra=_HASH_SQL))
def q_pool_weighted(spark, sf):
    return V.pool_chunks(_chunk_vectors(spark, sf), "weighted")


_TOKVEC_SQL = """
tv AS (SELECT vec_id // 10 AS doc_id, CAST(vec_id % 10 AS INTEGER) AS pos, CASE WHEN label > 0 THEN 1 ELSE 0 END AS mask,
              CAST(i - 1 AS INTEGER) AS dim, CAST(v AS DOUBLE) AS value
       FROM (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings))
"""


def _token_vectors(spark, sf):
    """Token vectors for pooling checks: every 10 consecutive embedding rows form one
    document's token sequence; label 0 marks padding (mask 0)."""
    e = read_table(spark, sf, "embeddings")
    return e.select(F.expr("vec_id div 10").alias("doc_id"), (F.col("vec_id") % 10).cast("int").alias("pos"),
                    F.when(F.col("label") > 0, 1).otherwise(0).alias("mask"),
                    F.posexplode(F.col("embedding").cast("array<double>")).alias("dim", "value"))


@register("masked_mean_pool", _fx(
    f"SELECT doc_id, dim, {r6('CASE WHEN sum(v * v) OVER p > 0 THEN v / sqrt(sum(v * v) OVER p) ELSE v END', 'value')} FROM ("
    "SELECT doc_id, dim, coalesce(avg(value) FILTER (WHERE mask = 1), 0.0) AS v FROM tv GROUP BY doc_id, dim) "
    "WINDOW p AS (PARTITION BY doc_id)", extra=_TOKVEC_SQL))
def q_masked_mean(spark, sf):
    return V.masked_mean_pool(_token_vectors(spark, sf))


@register("first_token_pool", _fx(
    f"SELECT doc_id, dim, {r6('value / sqrt(sum(value * value) OVER (PARTITION BY doc_id))', 'value')} FROM tv "
    "WHERE (doc_id, pos) IN (SELECT (doc_id, min(pos)) FROM tv GROUP BY doc_id)", extra=_TOKVEC_SQL))
def q_first_token(spark, sf):
    return V.first_token_pool(_token_vectors(spark, sf))


_LAST_LAYER_SQL = """
ll AS (SELECT e.* FROM attention_edges e JOIN (SELECT doc, max(layer) AS l FROM attention_edges GROUP BY doc) m
       ON e.doc = m.doc AND e.layer = m.l),
hm AS (SELECT doc, from_pos, to_pos, sum(w) / max(h) AS w FROM (
         SELECT doc, head, from_pos, to_pos, avg(weight) AS w FROM ll GROUP BY ALL) p
       JOIN (SELECT doc, count(DISTINCT head) AS h FROM ll GROUP BY doc) hh USING (doc) GROUP BY doc, from_pos, to_pos)
"""


@register("token_importance", _fx(
    f"""SELECT doc, to_pos, {r6('importance', 'importance')}, CAST(rank AS INTEGER) AS rank FROM (
          SELECT *, row_number() OVER (PARTITION BY doc ORDER BY importance DESC, to_pos) AS rank FROM (
            SELECT doc, to_pos, sum(w) / max(n) AS importance FROM hm JOIN (SELECT doc, greatest(max(from_pos), max(to_pos)) + 1 AS n FROM attention_edges GROUP BY doc) USING (doc) GROUP BY doc, to_pos)) WHERE rank <= 10""",
    "attention_edges", extra=_LAST_LAYER_SQL))
def q_token_importance(spark, sf):
    return V.token_importance(C.attention_edges(spark, sf)).withColumn("rank", F.col("rank").cast("int"))


@register("keyword_attention", _fx(
    f"""SELECT doc, layer, {r6('coalesce(sum(CASE WHEN from_pos = 0 THEN w END) / (max(h) * 16), 0.0)', 'mean_from')},
           {r6('coalesce(sum(CASE WHEN to_pos = 0 THEN w END) / (max(h) * 16), 0.0)', 'mean_to')}
        FROM (SELECT doc, layer, head, from_pos, to_pos, avg(weight) AS w FROM attention_edges GROUP BY ALL) p
        JOIN (SELECT doc, layer, count(DISTINCT head) AS h FROM attention_edges GROUP BY ALL) hh USING (doc, layer)
        GROUP BY doc, layer""", "attention_edges"))
def q_keyword_attention(spark, sf):
    return V.keyword_attention(C.attention_edges(spark, sf), position=0)


_PROFILE_SQL = _TOKENS_SQL.rstrip() + """,
kfirst AS (SELECT doc, keyword, min(pos) AS pos FROM hits GROUP BY doc, keyword),
one AS (SELECT doc, layer, head, from_pos, to_pos, avg(weight) AS w FROM document_edges GROUP BY ALL),
heads AS (SELECT doc, layer, count(DISTINCT head) AS h FROM document_edges GROUP BY ALL),
kedge AS (SELECT doc, keyword, layer, pos, sum(f) / max(h) AS f, sum(t) / max(h) AS t FROM (
            SELECT o.doc, k.keyword, o.layer, o.to_pos AS pos, o.w AS f, 0.0 AS t FROM one o JOIN kfirst k ON k.doc = o.doc AND k.pos = o.from_pos
            UNION ALL SELECT o.doc, k.keyword, o.layer, o.from_pos, 0.0, o.w FROM one o JOIN kfirst k ON k.doc = o.doc AND k.pos = o.to_pos)
          JOIN heads USING (doc, layer) GROUP BY doc, keyword, layer, pos),
lens AS (SELECT doc, count(*) AS n FROM toks GROUP BY doc)
"""


def _profile_input(spark, sf):
    """(edges, first keyword positions, tokens, lengths) of the documents, positions counted alike."""
    docs = _docs(spark, sf).withColumnRenamed("doc_id", "doc")
    first = T.keyword_hits(docs, key="doc").groupBy("doc", "keyword").agg(F.min("pos").alias("pos"))
    split = F.split(F.lower(F.col("text")), r"\s+")
    return (C.document_edges(spark, sf), first, docs.select("doc", F.posexplode(split).alias("pos", "token")),
            docs.select("doc", F.size(split).alias("n_tokens")))


@register("keyword_profile_layers", _fx(
    f"""SELECT k.doc, k.keyword, heads.layer, {r6('coalesce(f, 0.0) / n', 'mean_from')}, {r6('coalesce(t, 0.0) / n', 'mean_to')}
        FROM kfirst k JOIN heads ON heads.doc = k.doc JOIN lens ON lens.doc = k.doc
        LEFT JOIN (SELECT doc, keyword, layer, sum(f) AS f, sum(t) AS t FROM kedge GROUP BY ALL) s
               ON s.doc = k.doc AND s.keyword = k.keyword AND s.layer = heads.layer""", "document_edges", extra=_PROFILE_SQL))
def q_keyword_profile_layers(spark, sf):
    """Mean attention from and to each keyword's first position, over all tokens, in every layer."""
    edges, first, _, lengths = _profile_input(spark, sf)
    return V.keyword_layers(edges, first, lengths)


@register("keyword_profile_top", _fx(
    f"""SELECT doc, keyword, direction, CAST(rank AS INTEGER) AS rank, pos, token, {r6('attention', 'attention')} FROM (
          SELECT *, row_number() OVER (PARTITION BY doc, keyword, direction ORDER BY {r6('attention')} DESC, pos) AS rank FROM (
            SELECT k.doc, k.keyword, d.direction, toks.pos, toks.token, coalesce(CASE WHEN d.direction = 'from' THEN e.f ELSE e.t END, 0.0) AS attention
            FROM kfirst k JOIN (SELECT doc, max(layer) AS layer FROM document_edges GROUP BY doc) l ON l.doc = k.doc
            JOIN toks ON toks.doc = k.doc CROSS JOIN (SELECT unnest(['from', 'to']) AS direction) d
            LEFT JOIN kedge e ON e.doc = k.doc AND e.keyword = k.keyword AND e.layer = l.layer AND e.pos = toks.pos)) WHERE rank <= 20""",
    "document_edges", extra=_PROFILE_SQL))
def q_keyword_profile_top(spark, sf):
    """The 20 tokens with most attention from and to each keyword in the last layer."""
    edges, first, tokens, _ = _profile_input(spark, sf)
    return V.keyword_top_tokens(edges, first, tokens)


@register("normalize_attention", _fx(
    f"""SELECT doc, layer, head, from_pos, to_pos, {r6('weight', 'weight')},
           {r6('CASE WHEN max(weight) OVER w = min(weight) OVER w THEN 1.0 ELSE (weight - min(weight) OVER w) / (max(weight) OVER w - min(weight) OVER w) END', 'norm_weight')}
        FROM attention_edges WINDOW w AS (PARTITION BY doc, layer, head)""", "attention_edges"))
def q_normalize_attention(spark, sf):
    return V.normalize_attention(C.attention_edges(spark, sf))


@register("representation_error", _fx(
    f"SELECT model, {r6('min(abs(yhat - y))', 'min')}, {r6('max(abs(yhat - y))', 'max')}, {r6('avg(abs(yhat - y))', 'mean')}, "
    f"{r6('median(abs(yhat - y))', 'median')} FROM model_predictions GROUP BY model", "model_predictions"))
def q_representation_error(spark, sf):
    return V.representation_error(C.model_predictions(spark, sf))
