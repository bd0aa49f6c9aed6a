"""Document vectors: chunk encoding, pooling, attention-edge analytics (T12-T15,
T17-T19, T22).

Vectors are handled in long form (doc, [chunk,] dim, value) so pooling is a grouped
weighted sum by (doc, dim) - no per-document Python and no dense matrix on the
driver.  The default encoder is signed feature hashing of tokens (no weights to
ship); a real model plugs in through :func:`encode_documents` (``mapInPandas``
with the model loaded once per task).
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, StructType

from respan.functions.quantiles import exact_percentiles
from respan.operators.text import BERT_MAX_LENGTH, chunk_tokens, tokenize

HASH_DIM = 64
# Position weights of the weighted chunk pooling
FIRST_WEIGHT = 1.5
LAST_WEIGHT = 1.3


def hash_encode_chunks(chunks: DataFrame, dim: int = HASH_DIM, key: str = "doc_id") -> DataFrame:
    """T15 default encoder: signed hashing of the chunk's tokens into ``dim`` buckets,
    each chunk vector L2-normalised.  Output (doc, n_chunks, chunk_idx, dim, value), zeros
    omitted; a chunk or document without a token is a zero vector: one row (dim 0, value 0)."""
    part = [key, "n_chunks", "chunk_idx"]
    t = chunks.select(key, "n_chunks", F.coalesce("chunk_idx", F.lit(0)).alias("chunk_idx"), "tokens")
    schema = StructType([t.schema[c] for c in part]).add("dim", IntegerType()).add("value", DoubleType())
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in (b.slice(a, HASHED_ROWS) for a in range(0, b.num_rows, HASHED_ROWS)):
                row, at, value = _hashed(piece.column(3), dim)
                heads = [piece.column(c).take(pa.array(row)) for c in range(3)]
                yield pa.RecordBatch.from_arrays([*heads, pa.array(at), pa.array(value)], schema=arrow)

    # rows that share a key are one document; dealt by key, they need no other shuffle here or in the pooling
    sums = t.mapInArrow(run, schema).repartition(key).groupBy(*part, "dim").agg(F.sum("value").alias("value"))
    return _sparse(sums, part, dim_zero=True)


#: Chunks whose tokens are hashed at a time.
HASHED_ROWS = 2048


def _hashed(lists: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, dimension, sum of signs) of lists of tokens, without sums of zero; a list that has none
    gives dimension 0.  Of a token's MD5, 4 hex digits choose the dimension and the last bit of the fifth the sign."""
    length = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
    tokens = lists.flatten().dictionary_encode()
    five = np.array([int.from_bytes(hashlib.md5(t.encode()).digest()[:3], "big") >> 4 for t in tokens.dictionary.to_pylist()] or [0])
    code = np.asarray(pc.fill_null(tokens.indices, 0)).astype(np.int64)
    sign = np.where(five[code] % 2 == 0, 1.0, -1.0) * np.asarray(pc.is_valid(tokens.indices))
    sums = np.bincount(np.repeat(np.arange(len(length)), length) * dim + (five[code] // 16) % dim, sign, len(length) * dim)
    found = sums.reshape(len(length), dim) != 0
    found[~found.any(axis=1), 0] = True
    row, at = np.nonzero(found)
    return row, at.astype(np.int32), sums[row * dim + at]


def _sparse(v: DataFrame, part: list[str], dim_zero: bool = False) -> DataFrame:
    """L2-normalised vectors without their zeros; a vector of zeros keeps one row
    (dimension 0 with ``dim_zero``, else its least one), so nothing disappears."""
    w = Window.partitionBy(*part)
    v = (v.withColumn("_top", F.max(F.abs("value")).over(w)).withColumn("_d0", F.min("dim").over(w))
         .where((F.abs("value") > 1e-12) | ((F.col("_top") <= 1e-12) & (F.col("dim") == F.col("_d0")))))
    if dim_zero:
        v = v.withColumn("dim", F.when(F.col("_top") <= 1e-12, F.lit(0)).otherwise(F.col("dim")))
    return l2_normalize(v.drop("_top", "_d0"), part)


def l2_normalize(long: DataFrame, part) -> DataFrame:
    norm = F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy(*part)))
    return long.withColumn("value", F.when(norm > 0, F.col("value") / norm).otherwise(F.col("value")))


def pool_chunks(vecs: DataFrame, how: str = "mean", key: str = "doc_id") -> DataFrame:
    """Pool chunk vectors per document: ``mean``; ``first_last`` (mean of first and
    last chunk, the only chunk when single); ``weighted`` (first 1.5, last 1.3, others
    1, divided by the weight sum).  Unknown names fall back to mean.  Result L2-normalised."""
    v = vecs.withColumn("_last", F.greatest(F.col("n_chunks") - 1, F.lit(0)))
    first, last = F.col("chunk_idx") == 0, F.col("chunk_idx") == F.col("_last")
    if how == "first_last":
        w = F.when(first | last, 1.0).otherwise(0.0)
        denom = F.when(F.col("_last") == 0, 1.0).otherwise(2.0)
    elif how == "weighted":
        w = F.when(first, FIRST_WEIGHT).when(last, LAST_WEIGHT).otherwise(1.0)
        denom = F.when(F.col("_last") == 0, FIRST_WEIGHT).otherwise(
            FIRST_WEIGHT + LAST_WEIGHT + (F.col("_last") - 1).cast("double"))
    else:
        w = F.lit(1.0)
        denom = (F.col("_last") + 1).cast("double")
    pooled = v.groupBy(key, "dim").agg(F.sum(F.col("value") * w / denom).alias("value"))
    return _sparse(pooled, [key])


def masked_mean_pool(tok: DataFrame, key: str = "doc_id") -> DataFrame:
    """Mean of token vectors where mask = 1, per (doc, dim), L2-normalised; a document
    whose positions are all masked is a zero vector."""
    mean = tok.groupBy(key, "dim").agg(F.coalesce(F.avg(F.when(F.col("mask") == 1, F.col("value"))), F.lit(0.0)).alias("value"))
    return l2_normalize(mean, [key])


def first_token_pool(tok: DataFrame, key: str = "doc_id") -> DataFrame:
    """Vector of the first (CLS) position, L2-normalised."""
    first = tok.groupBy(key).agg(F.min("pos").alias("_p"))
    v = tok.join(first, key).where(F.col("pos") == F.col("_p")).select(key, "dim", "value")
    return l2_normalize(v, [key])


FALLBACK_CHARS = 1000  # fixed value (reference's last resort)
#: Documents that a task takes from an Arrow batch at a time.
ENCODED_ROWS = 64


def encode_in_parts(encode: Callable[[list[str]], Sequence], texts: list[str], batch: int) -> tuple[list, list]:
    """Vectors and errors of texts from an encoder that takes lists: a failing call is cut in half
    until the texts that fail stand alone; theirs are None with the error's text."""
    vecs: list = [None] * len(texts)
    errors: list = [None] * len(texts)
    waiting = [(a, min(a + batch, len(texts))) for a in range(0, len(texts), batch)][::-1]
    while waiting:
        a, b = waiting.pop()
        try:
            found = list(encode(texts[a:b]))
            if len(found) != b - a:
                raise ValueError(f"{len(found)} vectors for {b - a} texts")
            vecs[a:b] = [np.asarray(v, float) for v in found]
        except Exception as ex:  # the encoder is foreign code: any failure is isolated
            if b - a > 1:
                waiting += [((a + b) // 2, b), (a, (a + b) // 2)]
            else:
                errors[a] = repr(ex)
    return vecs, errors


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of ENCODED_ROWS: what Python makes of their texts is all that it holds beside the batch."""
    for a in range(0, batch.num_rows, ENCODED_ROWS):
        yield batch.slice(a, ENCODED_ROWS)


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v)
    return v / n if n else v


def _pooled(vecs: list[np.ndarray], how: str) -> np.ndarray:
    units = [_unit(v) for v in vecs]
    return _unit((units[0] + units[-1]) / 2 if how == "first_last" else np.mean(units, axis=0))


def encode_documents(docs: DataFrame, make_encoder: Callable[[], Callable[[list[str]], Sequence]], key: str = "doc_id", text: str = "text",
                     chunks: str = "plain", pool: str = "mean", blank: str = "space", dim: int | None = None, batch: int = 16) -> DataFrame:
    """Documents encoded chunk by chunk with a user model, built once per task.

    Chunks (T11, texts of their tokens) go to the encoder in lists of ``batch``; a chunk that fails is
    left out (:func:`encode_in_parts`).  A document without any encoded chunk is tried as its
    truncated text, then as its first 1000 characters (``level`` says which; the reference's
    ladder).  A blank text is encoded as one space (``blank`` = "space") or is a zero vector of
    ``dim`` numbers ("zero", which also stands for a document that failed at every level).

    Columns: key, vec, dim (null without a vector), level (chunks, truncated, first_1000, blank, failed), n_chunks,
    n_failed, token_count, file_size_bytes, processing_time_seconds, timestamp, error (the first)."""
    if blank not in ("space", "zero") or (blank == "zero" and dim is None):
        raise ValueError("blank is 'space', or 'zero' with a number of dimensions")
    body = F.coalesce(F.col(text), F.lit(""))
    d = docs.select(key, body.alias("t"), tokenize(body).alias("_t"))
    parts = F.transform(chunk_tokens(F.col("_t"), chunks), lambda c: F.array_join(c, " "))
    d = d.select(key, "t", F.size("_t").cast("long").alias("token_count"), parts.alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make_encoder()
        for b in (part for whole in batches for part in _pieces(whole)):
            rows = []
            for k, t, tokens, pieces in zip(*(c.to_pylist() for c in b.columns), strict=True):
                began = time.perf_counter()
                empty = not t.strip()
                # a text of signs only has no token: it is its own chunk
                short = " ".join(" ".join(pieces[:2] if chunks == "plain" else pieces[:1]).split(" ")[:BERT_MAX_LENGTH])
                pieces = [] if empty else (pieces or [t])
                vecs, errors = encode_in_parts(encode, pieces, batch)
                good = [v for v in vecs if v is not None]
                level, vec = ("chunks", _pooled(good, pool)) if good else ("failed", None)
                if empty:
                    level, vec = "blank", None
                    if blank == "space":
                        tries = [("blank", " ")]
                    else:
                        tries, vec = [], np.zeros(dim)
                else:
                    tries = [("truncated", short or t), ("first_1000", t[:FALLBACK_CHARS])]
                for name, line in tries:
                    if vec is None:
                        one, failed = encode_in_parts(encode, [line], 1)
                        errors += failed
                        if one[0] is not None:
                            level, vec = name, _unit(one[0])
                if vec is None:
                    level = "failed"
                    vec = np.zeros(dim) if blank == "zero" else None
                rows.append((k, None if vec is None else vec.tolist(), None if vec is None else len(vec), level, len(pieces),
                             sum(v is None for v in vecs), tokens, len(t.encode()), time.perf_counter() - began, pd.Timestamp.now("UTC"),
                             next((e for e in errors if e), None)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    kind = docs.schema[key].dataType.simpleString()
    schema = (f"`{key}` {kind}, vec array<double>, dim int, level string, n_chunks long, n_failed long, token_count long, "
              "file_size_bytes long, processing_time_seconds double, timestamp timestamp, error string")
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return d.mapInArrow(run, schema)


def last_layer_head_mean(edges: DataFrame) -> DataFrame:
    """Head-averaged attention of each document's last layer: (doc, from_pos, to_pos, w)."""
    last = edges.groupBy("doc").agg(F.max("layer").alias("_l"))
    e = edges.join(last, "doc").where(F.col("layer") == F.col("_l"))
    per_head = e.groupBy("doc", "head", "from_pos", "to_pos").agg(F.avg("weight").alias("w"))
    heads = e.groupBy("doc").agg(F.countDistinct("head").alias("_h"))
    # average over all heads of the layer: a head without the edge contributes 0
    s = per_head.groupBy("doc", "from_pos", "to_pos").agg(F.sum("w").alias("sw"))
    return s.join(heads, "doc").select("doc", "from_pos", "to_pos", (F.col("sw") / F.col("_h")).alias("w"))


def token_importance(edges: DataFrame, top_k: int = 10) -> DataFrame:
    """T17 + W13: mean attention each position receives in the last layer (heads
    averaged, missing edges count as 0 over the document's positions), top-k per document."""
    m = last_layer_head_mean(edges)
    size = edges.groupBy("doc").agg((F.greatest(F.max("from_pos"), F.max("to_pos")) + 1).alias("_n"))
    recv = m.join(size, "doc").groupBy("doc", "to_pos").agg((F.sum("w") / F.max("_n")).alias("importance"))
    w = Window.partitionBy("doc").orderBy(F.col("importance").desc(), F.col("to_pos"))
    return recv.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)


def keyword_attention(edges: DataFrame, position: int = 0, seq_len: int = 16) -> DataFrame:
    """Per document and layer, mean attention from and to one (keyword) position,
    heads averaged and missing edges counted as 0."""
    heads = edges.groupBy("doc", "layer").agg(F.countDistinct("head").alias("_h"))
    ph = edges.groupBy("doc", "layer", "head", "from_pos", "to_pos").agg(F.avg("weight").alias("w"))
    ph = ph.join(heads, ["doc", "layer"])
    frm = F.sum(F.when(F.col("from_pos") == position, F.col("w"))) / (F.first("_h") * seq_len)
    to = F.sum(F.when(F.col("to_pos") == position, F.col("w"))) / (F.first("_h") * seq_len)
    return ph.groupBy("doc", "layer").agg(F.coalesce(frm, F.lit(0.0)).alias("mean_from"),
                                          F.coalesce(to, F.lit(0.0)).alias("mean_to"))


TOP_TOKENS = 20  # fixed value (reference default)
#: Attention edges that a task groups.
TASK_EDGES = 1 << 20


def keyword_edges(edges: DataFrame, first: DataFrame) -> DataFrame:
    """(doc, keyword, layer, pos, attention_from, attention_to) between each keyword's first
    position (``first``: doc, keyword, pos) and every token it has an edge with, in every layer.

    Heads are averaged, a head without the edge counts as 0.  Both joins are on (document,
    position), so edges that touch no keyword drop out at once."""
    return _keyword_edges(_spread(edges), first)


def _spread(edges: DataFrame) -> DataFrame:
    """Edges dealt by document, about TASK_EDGES to a task at any size: nearly every edge is a group
    of its own, and a task holds the groups of what it reads."""
    tasks = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-edges.count() // TASK_EDGES))
    return edges.repartition(tasks, "doc")


def _keyword_edges(edges: DataFrame, first: DataFrame) -> DataFrame:
    """:func:`keyword_edges` of edges that are dealt already."""
    one = edges.groupBy("doc", "layer", "head", "from_pos", "to_pos").agg(F.avg("weight").alias("w"))
    at = first.select("doc", "keyword", F.col("pos").alias("at"))

    def side(near: str, far: str, column: str, other: str) -> DataFrame:
        near_edges = one.select("doc", "layer", F.col(near).alias("at"), F.col(far).alias("pos"), F.col("w").alias(column))
        return near_edges.join(at, ["doc", "at"]).withColumn(other, F.lit(0.0)).select(
            "doc", "keyword", "layer", "pos", "attention_from", "attention_to")

    both = side("from_pos", "to_pos", "attention_from", "attention_to").unionByName(
        side("to_pos", "from_pos", "attention_to", "attention_from"))
    heads = edges.groupBy("doc", "layer").agg(F.countDistinct("head").alias("_h"))
    summed = both.groupBy("doc", "keyword", "layer", "pos").agg(F.sum("attention_from").alias("f"), F.sum("attention_to").alias("t"))
    return summed.join(heads, ["doc", "layer"]).select("doc", "keyword", "layer", "pos", (F.col("f") / F.col("_h")).alias("attention_from"),
                                                       (F.col("t") / F.col("_h")).alias("attention_to"))


def keyword_layers(edges: DataFrame, first: DataFrame, lengths: DataFrame) -> DataFrame:
    """Per (doc, keyword, layer) the mean attention from and to the keyword over all of the
    document's tokens (``lengths``: doc, n_tokens); layers without such an edge have 0."""
    edges = _spread(edges)
    layers = edges.select("doc", "layer").distinct()
    sums = _keyword_edges(edges, first).groupBy("doc", "keyword", "layer").agg(
        F.sum("attention_from").alias("f"), F.sum("attention_to").alias("t"))
    every = first.select("doc", "keyword").join(layers, "doc").join(lengths, "doc")
    zero = F.lit(0.0)
    return every.join(sums, ["doc", "keyword", "layer"], "left").select(
        "doc", "keyword", "layer", (F.coalesce("f", zero) / F.col("n_tokens")).alias("mean_from"),
        (F.coalesce("t", zero) / F.col("n_tokens")).alias("mean_to"))


def keyword_vectors(edges: DataFrame, first: DataFrame, lengths: DataFrame) -> DataFrame:
    """(doc, keyword, layer, attention_from, attention_to) with arrays over all tokens of the document."""
    edges = _spread(edges)
    layers = edges.select("doc", "layer").distinct()
    every = first.select("doc", "keyword").join(layers, "doc").join(lengths, "doc").select(
        "doc", "keyword", "layer", F.explode(F.sequence(F.lit(0), F.col("n_tokens").cast("int") - 1)).alias("pos"))
    zero = F.lit(0.0)
    dense = every.join(_keyword_edges(edges, first), ["doc", "keyword", "layer", "pos"], "left").groupBy("doc", "keyword", "layer").agg(
        F.sort_array(F.collect_list(F.struct("pos", F.coalesce("attention_from", zero).alias("f"),
                                             F.coalesce("attention_to", zero).alias("t")))).alias("v"))
    return dense.select("doc", "keyword", "layer", F.col("v.f").alias("attention_from"), F.col("v.t").alias("attention_to"))


def keyword_top_tokens(edges: DataFrame, first: DataFrame, tokens: DataFrame, top_k: int = TOP_TOKENS) -> DataFrame:
    """(doc, keyword, direction, rank, pos, token, attention): the ``top_k`` tokens of each
    document (``tokens``: doc, pos, token) with most attention from and to the keyword in
    the document's last layer, ties and tokens without an edge by position.

    Tokens without an edge can only fill up the list, and its places are then the document's
    first positions, so ``top_k`` of them are enough."""
    edges = _spread(edges)
    last = edges.groupBy("doc").agg(F.max("layer").alias("layer"))
    found = _keyword_edges(edges, first).join(last, ["doc", "layer"]).select("doc", "keyword", "pos", "attention_from", "attention_to")
    fill = (first.select("doc", "keyword").join(last.select("doc"), "doc")
            .join(tokens.where(F.col("pos") < top_k).select("doc", "pos"), "doc")
            .select("doc", "keyword", "pos", F.lit(0.0).alias("attention_from"), F.lit(0.0).alias("attention_to")))
    both = found.unionByName(fill).groupBy("doc", "keyword", "pos").agg(F.sum("attention_from").alias("from"), F.sum("attention_to").alias("to"))
    long = both.select("doc", "keyword", "pos", F.explode(F.create_map(F.lit("from"), "from", F.lit("to"), "to")).alias("direction", "attention"))
    order = Window.partitionBy("doc", "keyword", "direction").orderBy(F.col("attention").desc(), "pos")
    top = long.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
    return top.join(tokens, ["doc", "pos"]).select("doc", "keyword", "direction", "rank", "pos", "token", "attention")


def normalize_attention(edges: DataFrame) -> DataFrame:
    """Min-max normalise each (doc, layer, head) matrix; a constant matrix -> 1."""
    w = Window.partitionBy("doc", "layer", "head")
    lo, hi = F.min("weight").over(w), F.max("weight").over(w)
    return edges.withColumn("norm_weight", F.when(hi == lo, F.lit(1.0)).otherwise((F.col("weight") - lo) / (hi - lo)))


def representation_error(scored: DataFrame, groups=("model",)) -> DataFrame:
    """|prediction - actual| min / max / mean / median beside a projection."""
    groups = list(groups)
    e = scored.withColumn("abs_err", F.abs(F.col("yhat") - F.col("y")))
    base = e.groupBy(*groups).agg(F.min("abs_err").alias("min"), F.max("abs_err").alias("max"),
                                  F.avg("abs_err").alias("mean"))
    return base.join(exact_percentiles(e, "abs_err", [0.5], groups, names=["median"]), groups)
