"""Text features: tokens, n-grams, TF-IDF fitted on train documents, chunking,
keyword positions and document metadata (T1-T8, T10, T11, T16, T23).

TF-IDF follows the scikit-learn definition the reference uses (lower-case, tokens of
two or more word characters, uni+bigrams, min_df = 2, top 10 000 terms by corpus
frequency, sublinear tf, smoothed idf ln((1+n)/(1+df)) + 1, L2 row norm).  The model
is a *table* (term, idf).  Without ``max_features`` it holds every term and meets the
counts by a shuffle on the term; with it (the top-k the reference takes by default)
its size is bounded, so it is broadcast.  Features stay sparse as (doc, term, weight) rows.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from respan.operators.terms import PackedTerms, pack_terms

# Fixed values (must equal the reference's constants)
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"
MAX_FEATURES = 10000
MIN_DF = 2
BERT_MAX_LENGTH = 510
CHUNK_OVERLAP = 50
MAX_CHUNKS = 12
PRECOMPUTE_MAX_LENGTH = 1024
PRECOMPUTE_OVERLAP = 100
DSL_KEYWORDS = ["component", "interface", "service", "operation", "provides", "requires", "repository",
                "system", "allocation", "resource", "container", "parameter", "from", "to", "RETURN"]


def tokenize(text: Column) -> Column:
    """Lower-cased tokens of >= 2 Unicode word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), 0)


def with_ngrams(tokens: Column) -> Column:
    """Unigrams followed by bigrams ('a b'); documents with < 2 tokens have none.

    ``tokens`` should be a column reference (materialise the tokeniser first): the
    expression reads it several times."""
    n = F.size(tokens)
    bigrams = F.when(n >= 2, F.zip_with(F.slice(tokens, 1, n - 1), F.slice(tokens, 2, n - 1),
                                        lambda a, b: F.concat(a, F.lit(" "), b))
                     ).otherwise(F.array().cast("array<string>"))
    return F.concat(tokens, bigrams)


def term_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """(doc, [keep...], term, tf) rows for uni+bigrams (tokenised once per document)."""
    keep = list(keep)
    # texts move once, by document: the counts of (document, term) need no shuffle of their own
    t = docs.select(key, *keep, text).repartition(key).select(key, *keep, tokenize(F.col(text)).alias("_t"))
    t = t.select(key, *keep, F.explode(with_ngrams(F.col("_t"))).alias("term"))
    return t.groupBy(key, *keep, "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(tf: DataFrame, min_df: int = MIN_DF) -> DataFrame:
    """Per term document frequency and corpus frequency, df >= min_df."""
    return (tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
            .where(F.col("df") >= min_df))


def vocabulary(dfreq: DataFrame, max_features: int | None = MAX_FEATURES) -> DataFrame:
    """T4: top ``max_features`` terms by corpus frequency (ties: term ascending); None: all.
    A top-k (per-partition heaps of k rows), so at most k rows reach one task."""
    if max_features is None:
        return dfreq
    return dfreq.orderBy(F.col("cf").desc(), F.col("term").asc()).limit(max_features)


def fit_tfidf(train_docs: DataFrame, key: str = "doc_id", text: str = "text",
              max_features: int | None = None, min_df: int = MIN_DF) -> DataFrame:
    """The fitted model as a table (term, df, idf)."""
    tf = term_counts(train_docs, key, text)
    n_docs = train_docs.select(key).distinct().count()
    voc = vocabulary(document_frequency(tf, min_df), max_features)
    return voc.select("term", "df", (F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


def model_from_counts(tf_train: DataFrame, n_docs: int, max_features: int | None = None,
                      min_df: int = MIN_DF) -> DataFrame:
    """T3-T6 from precomputed training term counts."""
    voc = vocabulary(document_frequency(tf_train, min_df), max_features)
    return voc.select("term", "df", (F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


def fit_transform_tfidf(docs: DataFrame, is_train, key: str = "doc_id", text: str = "text",
                        keep: Sequence[str] = (), max_features: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Fit on the training rows and weight *all* rows from one tokenisation pass: documents are packed
    into units (:mod:`respan.operators.terms`), from which both the vocabulary and the weights come."""
    keep = [key, *keep]
    packed = packed_terms(docs, is_train, key, text, keep[1:])
    model = vocabulary(packed.frequencies(), max_features).select(
        "term", "df", (F.log((1.0 + packed.n_docs) / (1.0 + F.col("df"))) + 1.0).alias("idf"))
    if max_features is None:
        return model, packed.weights(keep)
    return model, weights_from_counts(packed.counts(keep), model, key, max_features)


def packed_terms(docs: DataFrame, is_train, key: str = "doc_id", text: str = "text", keep: Sequence[str] = (),
                 min_df: int = MIN_DF) -> PackedTerms:
    """The uni+bigrams of all documents in packed units."""
    return pack_terms(docs, is_train, tokenize, key, text, keep, min_df)


def _bounded(model: DataFrame, max_features: int | None) -> DataFrame:
    """The model for a join: broadcast only if a bound on its rows is known."""
    m = model.select("term", "idf")
    return F.broadcast(m) if max_features is not None and max_features <= MAX_FEATURES else m


def weights_from_counts(tf: DataFrame, model: DataFrame, key: str = "doc_id",
                        max_features: int | None = None) -> DataFrame:
    """T5, T7, T8 on precomputed counts (extra columns of ``tf`` are kept)."""
    extra = [c for c in tf.columns if c not in (key, "term", "tf")]
    w = tf.join(_bounded(model, max_features), "term", "inner") \
        .withColumn("w", (F.lit(1.0) + F.log(F.col("tf").cast("double"))) * F.col("idf"))
    # extra columns (e.g. split) are per-document, so partitioning by them too is the
    # same window, and lets a later filter on them move below the window
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key, *extra)))
    return w.select(key, *extra, "term", (F.col("w") / norm).alias("weight"))


def transform_tfidf(docs: DataFrame, model: DataFrame, key: str = "doc_id", text: str = "text",
                    max_features: int | None = None) -> DataFrame:
    """Sublinear tf x idf over the frozen vocabulary (unseen terms dropped),
    L2-normalised per document; ``max_features`` is the bound the model was fitted with."""
    tf = term_counts(docs, key, text)
    w = tf.join(_bounded(model, max_features), "term", "inner") \
        .withColumn("w", (F.lit(1.0) + F.log(F.col("tf").cast("double"))) * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return w.select(key, "term", (F.col("w") / norm).alias("weight"))


def chunk_starts(n: Column, step: int) -> Column:
    return F.sequence(F.lit(0), n - 1, F.lit(step))


def chunk_tokens(tokens: Column, mode: str = "plain", max_chunks: int | None = None) -> Column:
    """T11 chunkers as an array of token arrays.

    plain      : used when len+2 > 510; step = width = 510-50-2 (no overlap);
                 shorter documents are one chunk
    overlap    : width W = max_length, step W-50, when len > W
    precompute : width 1024, step 1024-100, when len > 1024

    Every token is in a chunk; ``max_chunks`` (the reference takes MAX_CHUNKS = 12 in the
    first two) keeps the first so many only.
    """
    n = F.size(tokens)
    if mode == "plain":
        width = step = BERT_MAX_LENGTH - CHUNK_OVERLAP - 2
        long_doc, short_w = n + 2 > BERT_MAX_LENGTH, BERT_MAX_LENGTH
    elif mode == "overlap":
        width, step = BERT_MAX_LENGTH, BERT_MAX_LENGTH - CHUNK_OVERLAP
        long_doc, short_w = n > width, width
    elif mode == "precompute":
        width, step = PRECOMPUTE_MAX_LENGTH, PRECOMPUTE_MAX_LENGTH - PRECOMPUTE_OVERLAP
        long_doc, short_w = n > width, width
    else:
        raise ValueError(mode)
    chunks = F.transform(chunk_starts(n, step), lambda s: F.slice(tokens, s + 1, width))
    if max_chunks is not None:
        chunks = F.slice(chunks, 1, max_chunks)
    single = F.array(F.slice(tokens, 1, short_w))
    return F.when(n == 0, F.array().cast("array<array<string>>")).when(long_doc, chunks).otherwise(single)


def chunk_table(docs: DataFrame, mode: str, key: str = "doc_id", text: str = "text",
                max_chunks: int | None = None) -> DataFrame:
    """(doc, n_chunks, chunk_idx, tokens) rows; a document without a token has one row with
    n_chunks 0 and nulls.  The outer explode keeps Spark from adding a size filter that
    would run the tokeniser again."""
    d = docs.select(key, tokenize(F.coalesce(F.col(text), F.lit(""))).alias("_t"))
    d = d.select(key, chunk_tokens(F.col("_t"), mode, max_chunks).alias("chunks"))
    return d.select(key, F.size("chunks").alias("n_chunks"), F.posexplode_outer("chunks").alias("chunk_idx", "tokens"))


def keyword_hits(docs: DataFrame, keywords: Sequence[str] = DSL_KEYWORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, keyword, pos): tokens (split at white space, lower case) that contain a keyword.  Tokens
    without any are dropped before the others are repeated for each keyword that they hold."""
    words = sorted({k.lower() for k in keywords})
    toks = docs.select(key, F.posexplode(F.split(F.lower(F.col(text)), r"\s+")).alias("pos", "token"))
    toks = toks.where(F.col("token").rlike("|".join(re.escape(w) for w in words)))
    held = F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.col("token"), w))
    return toks.select(key, F.explode(held).alias("keyword"), "pos")


def keyword_positions(docs: DataFrame, keywords: Sequence[str] = DSL_KEYWORDS, key: str = "doc_id",
                      text: str = "text") -> DataFrame:
    """Positions of tokens containing each keyword (case-insensitive): count,
    first position and the position list."""
    return (keyword_hits(docs, keywords, key, text).groupBy(key, "keyword")
            .agg(F.count(F.lit(1)).alias("occurrences"), F.min("pos").alias("first_pos"),
                 F.sort_array(F.collect_list("pos")).alias("positions")))


def document_metadata(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """T23 + T10: token count, size in bytes, blank flag (blank text is embedded as ' '
    by the BERT path and as a zero vector by the LLaMA path)."""
    return docs.select(key, F.size(tokenize(F.col(text))).alias("token_count"),
                       F.octet_length(F.col(text)).alias("file_size_bytes"),
                       (F.trim(F.col(text)) == "").alias("is_blank"))
