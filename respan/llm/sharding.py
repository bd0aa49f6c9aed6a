"""Sharding by vector bin packing.

Every group of equal texts is an item with a size vector (bytes, tokens, rows).  Items
are placed in decreasing order, each into the shard where the dot product of its vector
with the shard's residual capacity is highest; groups stay together.  ``bytes`` is the law
that holds: the shards' byte sums are near equal (bytes weigh most in the products).

Scale: the placement itself sees at most :data:`CELLS` + ``3 * CELLS / 16`` items, however
many groups there are.  Groups that reach ``16 / CELLS`` of a total are items of their own;
all others share :data:`CELLS` hash cells, which are then the items.  A group with more
bytes than one shard's share cannot stay whole under the law: it is dealt by row into as
many parts as needed, each an item.  Cell sums are aggregated before they are shuffled.

Defined cases: a null text has size 1 and is the group of null texts (an empty text has
size 1 too, but is another group); ties go to the lower shard number; repeated rows are
rows of the same group; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from respan.llm.util import stored

CELLS = 1 << 14
#: Weights of the dimensions in the products.
WEIGHTS = {"bytes": 8.0, "tokens": 1.0, "rows": 1.0}
DIMS = tuple(WEIGHTS)
#: Parts a shard's share is cut into when a group is larger than a share.
PARTS_PER_SHARE = 64
#: Row buckets a shard is numbered in.
SLOT_BUCKETS = 4096


def measured(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One narrow row a document: key of its group of equal texts, sizes and checksum."""
    raw = F.col(text).cast("binary")
    return docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(F.sha2(raw, 256), F.lit("null")).alias("key"),
        (F.coalesce(F.octet_length(raw), F.lit(0)) + 1).cast("long").alias("bytes"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("tokens"),
        F.lit(1).cast("long").alias("rows"),
        F.coalesce(F.crc32(raw), F.crc32(F.lit("").cast("binary"))).cast("long").alias("text_crc32"))


def place(items: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each row of ``items`` (count, dims), largest first, by the highest dot
    product with the residual capacity (in shares of the totals)."""
    total = items.sum(axis=0)
    unit = items / np.where(total > 0, total, 1)
    weight = np.array([WEIGHTS[d] for d in DIMS])
    residual = np.full((shards, len(DIMS)), 1 / shards)
    out = np.zeros(len(items), np.int64)
    for i in np.lexsort((np.arange(len(items)), -(unit * weight).sum(axis=1))):
        s = int((residual @ (unit[i] * weight)).argmax())
        out[i] = s
        residual[s] -= unit[i]
    return out


def _cell(cells: int = CELLS) -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(cells)).cast("int")


def assign(rows: DataFrame, shards: int, cells: int = CELLS) -> DataFrame:
    """``rows`` (of :func:`measured`) with ``shard``."""
    spark = rows.sparkSession
    groups = rows.groupBy("key").agg(*[F.sum(d).alias(d) for d in DIMS])
    groups = stored(groups, "shard-groups")
    total = groups.agg(*[F.coalesce(F.sum(d), F.lit(0)).alias(d) for d in DIMS]).first()
    heavy_if = F.lit(False)
    for d in DIMS:
        heavy_if = heavy_if | (F.col(d) * cells >= F.lit(16 * max(total[d], 1)))
    heavy = {r["key"]: r for r in groups.where(heavy_if).collect()}  # at most 3 * cells / 16
    light = (groups.where(~heavy_if).groupBy(_cell(cells).alias("cell"))
             .agg(*[F.sum(d).alias(d) for d in DIMS]).orderBy("cell").collect())  # at most ``cells``
    names: list[tuple] = [(None, r["cell"], 0) for r in light]
    sizes = [[r[d] for d in DIMS] for r in light]
    share = max(total["bytes"], 1) / shards
    parts = {k: 1 if r["bytes"] <= share else int(np.ceil(r["bytes"] / share)) * PARTS_PER_SHARE
             for k, r in heavy.items()}
    turn = F.pmod(F.xxhash64("doc_id", "key"), F.col("parts")).cast("int")
    dealt = {(k, 0): heavy[k] for k in heavy if parts[k] == 1}
    if len(dealt) < len(heavy):  # at most ``shards`` groups are larger than a share
        cut = spark.createDataFrame([(k, n) for k, n in parts.items() if n > 1], "key string, parts int")
        dealt |= {(r["key"], r["part"]): r for r in rows.join(F.broadcast(cut), "key")
                  .groupBy("key", turn.alias("part")).agg(*[F.sum(d).alias(d) for d in DIMS]).collect()}
    for k, part in sorted((k, part) for k in heavy for part in range(parts[k])):
        names.append((k, None, part))
        sizes.append([dealt[k, part][d] for d in DIMS] if (k, part) in dealt else [0] * len(DIMS))
    where = place(np.array(sizes, float).reshape(-1, len(DIMS)), shards)
    found = list(zip(names, where.tolist(), strict=True))
    # both tables are bounded by the number of cells, so they may be broadcast
    by_cell = spark.createDataFrame([(n[1], s) for n, s in found if n[0] is None] or [(-1, 0)],
                                    "cell int, cell_shard int")
    by_key = spark.createDataFrame([(n[0], n[2], parts[n[0]], s) for n, s in found if n[0] is not None]
                                   or [("", 0, 1, 0)], "key string, part int, parts int, key_shard int")
    of_key = by_key.groupBy("key", "parts").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("part", "key_shard"))), lambda x: x["key_shard"]).alias("at"))
    return (rows.withColumn("cell", _cell(cells))
            .join(F.broadcast(by_cell), "cell", "left").join(F.broadcast(of_key), "key", "left")
            .withColumn("shard", F.coalesce(F.get("at", turn), "cell_shard"))
            .drop("cell", "cell_shard", "at", "parts"))


def numbered(rows: DataFrame, buckets: int = SLOT_BUCKETS) -> DataFrame:
    """``rows`` with ``slot``: a gapless number from 0 in each shard.  Rows are numbered
    within hash buckets; a table of (shard, bucket) counts, bounded by their number,
    gives each bucket's first slot."""
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "key"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = (rows.groupBy("shard", "bucket").count()
             .withColumn("first_slot", F.coalesce(F.sum("count").over(before), F.lit(0)))
             .select("shard", "bucket", "first_slot"))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "key")
    return (rows.withColumn("no", F.row_number().over(inside) - 1)
            .join(F.broadcast(first), ["shard", "bucket"])
            .withColumn("slot", (F.col("first_slot") + F.col("no")).cast("long"))
            .drop("bucket", "first_slot", "no"))


def shard(docs: DataFrame, shards: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, tokens) of every row."""
    rows = stored(measured(docs, doc_id, text), "shard-rows")
    placed = numbered(stored(assign(rows, shards), "shard-placed"))
    return placed.select("doc_id", F.col("bytes").alias("size"), "text_crc32", F.lit("bytes").alias("law"),
                         "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")


def write_shards(docs: DataFrame, path: str, shards: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write whole rows of ``docs`` (unique, non-null ids) partitioned by ``shard``, with
    their ``slot``; returns the assignment.  The tables meet on the id."""
    out = stored(shard(docs, shards, doc_id, text), "shard-result")
    at = out.select(F.col("doc_id").alias("_doc"), F.col("shard").alias("shard"), "slot")
    keep = [c for c in docs.columns if c not in ("shard", "slot")]
    (docs.select(*keep).join(at, F.col(doc_id).cast("long") == F.col("_doc")).drop("_doc")
     .write.partitionBy("shard").parquet(path))
    return out
