"""Document fingerprints by winnowing, with DataFrame functions only.

Tokens are words of letters and digits, and single code points of anything else that is
not white space (or of scripts written without spaces).  Hashes of :data:`K` consecutive
tokens are built by doubling (pairs, then pairs of pairs); every window of :data:`W` of
them keeps its least hash, the rightmost of equal ones, with its token position.  So any
run of ``K + W - 1`` tokens that two texts share leaves a common fingerprint, and a text
with fewer tokens has one.  The least of a window comes from doubling too: log2(W)
passes over an array, each window's value packed as (hash, reversed position).

The fingerprint is text: ``hash@position`` items (31-bit hash in hexadecimal) joined by
commas.  Likeness is the Jaccard similarity of two fingerprints' hash sets (1 if both
are empty).

Defined cases: a null text is empty; a text without a token has the empty fingerprint;
rows with equal ids follow each other in the order of a text hash (null ids come first),
so each row has one next row and the last is followed by the first; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, W = 4, 8
TOKEN = (r"[\p{L}\p{M}\p{N}&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]]+|[^\s]")
LOW = (1 << 31) - 1
#: Edges of the range buckets at each of two levels; 64 * 64 buckets at most.
EDGES = 64


def _doubled(a: str, by: int, merge) -> Column:
    """Element-wise merge of an array with itself ``by`` places on (shorter by ``by``)."""
    n = F.size(a) - F.lit(by)
    return F.when(n > 0, F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(by + 1), n), merge)).otherwise(
        F.expr("cast(array() as array<bigint>)"))


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with ``out``: the packed winners (array of long) of column ``text``."""
    t, g, v = f"{out}_t", f"{out}_g", f"{out}_v"
    df = df.withColumn(t, F.transform(F.regexp_extract_all(F.col(text), F.lit(TOKEN), F.lit(0)), lambda x: F.xxhash64(x)))
    k, df = 1, df.withColumn(g, F.col(t))
    while k < K:
        df = df.withColumn(g, _doubled(g, k, lambda a, b: F.xxhash64(a, b)))
        k *= 2
    # a text with fewer than K tokens is one gram of all
    df = df.withColumn(g, F.when((F.size(t) > 0) & (F.size(t) < K), F.array(F.xxhash64(t))).otherwise(F.col(g)))
    df = df.withColumn(v, F.transform(g, lambda x, i: F.shiftleft(F.shiftrightunsigned(x, 33), 32)
                                      .bitwiseOR((F.lit(LOW) - i).cast("long"))))
    w, df = 1, df.withColumn(out, F.col(v))
    while w < W:
        df = df.withColumn(out, _doubled(out, w, lambda a, b: F.least(a, b)))
        w *= 2
    df = df.withColumn(out, F.when((F.size(v) > 0) & (F.size(v) < W), F.array(F.array_min(v))).otherwise(F.col(out)))
    return df.withColumn(out, F.array_distinct(out)).drop(t, g, v)


def printed(packed: str) -> Column:
    return F.concat_ws(",", F.transform(packed, lambda x: F.concat(
        F.lower(F.lpad(F.hex(F.shiftright(x, 32)), 8, "0")), F.lit("@"), (F.lit(LOW) - x.bitwiseAND(LOW)).cast("string"))))


def hashes(packed: str) -> Column:
    return F.array_distinct(F.transform(packed, lambda x: F.shiftright(x, 32)))


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of two arrays of distinct hashes."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, F.lit(1.0)).otherwise(common / union)


def fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``docs`` with the printed fingerprint of every text."""
    return (with_fingerprint(docs.withColumn("_text", F.coalesce(F.col(text), F.lit(""))), "_text", "_fp")
            .withColumn(out, printed("_fp")).drop("_text", "_fp"))


def _bucketed(rows: DataFrame) -> DataFrame:
    """``rows`` (d, h, text) with ``bucket``: ranges of the id by approximate quantiles, found by
    two short scans of edge literals; the row that begins a bucket is repeated, marked as
    ``guest``, at the end of the bucket before (of the last one for the first)."""
    n = EDGES * EDGES
    edges = rows.agg(F.percentile_approx("d", [i / n for i in range(1, n)], 20000).alias("e")
                     ).first()["e"] or []
    edges = sorted(set(edges))
    fine = [edges[i:i + EDGES] for i in range(0, len(edges), EDGES)] or [[]]
    coarse = F.array(*[F.lit(x[0]).cast("long") for x in fine[1:]]) if len(fine) > 1 else F.expr("array(0L)")
    lists = F.array(*[F.array(*[F.lit(x).cast("long") for x in part]) if part else F.expr("cast(array() as array<bigint>)")
                      for part in fine])

    def count(a: Column) -> Column:
        return F.size(F.filter(a, lambda e: e <= F.coalesce("d", F.lit(-(1 << 63)))))

    at = count(coarse) if len(fine) > 1 else F.lit(0)
    rows = rows.withColumn("at", at).withColumn("bucket", F.col("at") * EDGES + count(F.get(lists, F.col("at")))).drop("at")
    # at most EDGES * EDGES rows of ids and hashes
    first = rows.groupBy("bucket").agg(F.min(F.struct(F.col("d").isNotNull().alias("k"), "d", "h")).alias("f")).collect()
    buckets = sorted(r["bucket"] for r in first)
    before = dict(zip(buckets, buckets[-1:] + buckets[:-1], strict=True))
    begins = rows.sparkSession.createDataFrame(
        [(r["bucket"], r["f"]["d"], r["f"]["h"], before[r["bucket"]]) for r in first],
        "bucket int, first_d long, first_h long, before int")
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("guest"))
    guest = F.struct(F.col("before").alias("bucket"), F.lit(True).alias("guest"))
    is_first = F.col("d").eqNullSafe(F.col("first_d")) & (F.col("h") == F.col("first_h"))
    return (rows.join(F.broadcast(begins), "bucket")
            .withColumn("seat", F.explode(F.when(is_first, F.array(own, guest)).otherwise(F.array(own))))
            .select("d", "h", "text", "seat.bucket", "seat.guest"))


def compare_with_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form, with likenesses.

    Edited: the last floor(n / 2) code points are replaced by the first as many of the
    next document (ascending id; after the last the first).  Texts are shuffled once, by
    range buckets; both windows and the fingerprints run on that partitioning."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("d"), F.xxhash64(body).alias("h"), body.alias("text"))
    order = Window.partitionBy("bucket").orderBy("guest", F.col("d").asc_nulls_first(), "h")
    out = _bucketed(rows).withColumn("next_text", F.lead("text").over(order))
    out = with_fingerprint(out, "text", "fp").withColumn("set", hashes("fp"))
    out = out.withColumn("next_set", F.lead("set").over(order)).where(~F.col("guest"))
    n = F.char_length("text")
    out = out.withColumn("n_chars", n.cast("long")).withColumn("half", F.floor(n / 2).cast("int"))
    out = out.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.char_length("text") - F.col("half")),
                                            F.substring(F.col("next_text"), F.lit(1), F.col("half"))))
    out = with_fingerprint(out, "edited", "efp").withColumn("eset", hashes("efp"))
    return out.select(F.col("d").alias("doc_id"), "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                      printed("fp").alias("fingerprint"), printed("efp").alias("edited_fingerprint"),
                      likeness("set", "eset").alias("near_edited"), likeness("set", "next_set").alias("near_next"))
