"""Median pruning over a table of intermediate values without a one-task group.

A trial is flagged at a step if its value is greater than the median of the values that earlier
trials (smaller numbers) of the study reported there.  For a value v, m earlier values, L of them
smaller than v, that is decided by L alone when m is odd, and for even m by L or, when
L = m / 2, by v against the mean of its two neighbours, the greatest earlier value below it and the
least from it on.  All three are offline order statistics and split into parts:

* every (study, step) is cut into ranges of numbers and buckets of values, about four square roots
  of its rows each, by quantile edges;
* counts, greatest and least values per (range, bucket), added up over earlier ranges and lower (or
  higher) buckets by two windows, cover all rows of other ranges in other buckets;
* rows of the same range, and rows of the same bucket from earlier ranges, are compared inside
  that range or bucket only: groups of a few square roots of the rows, streamed through tasks and
  counted by halving (array operations).  A bucket or range that is a single value has nothing
  to compare: its part comes from the counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from respan.functions.quantiles import bucketize
from respan.session import stored

GROUP = ["study", "step"]
#: Number of a (study, step): rows are shuffled, sorted and joined by it.
ID = "group_id"
#: Rows that a task compares at a time (more if one group has more).
HELD_ROWS = 1 << 16


def earlier_order(group: np.ndarray, order: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each row: rows of its group (ascending numbers) of smaller ``order``, those of them with a
    smaller ``value``, the greatest value among the latter and the least among the others (NaN if there is none).

    Rows are halved by order again and again; rows of an upper half find those of the lower half
    beside it by their place in the order of values."""
    n = len(order)
    by = np.lexsort((order, group))
    new = np.append(True, group[by][1:] != group[by][:-1]) if n else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # of each group
    tie = np.append(True, new[1:] | (order[by][1:] != order[by][:-1])) if n else new
    seen = np.empty(n, np.int64)
    seen[by] = np.maximum.accumulate(np.where(tie, np.arange(n), 0)) - start
    rank = seen  # rows of one order share it, and gaps do no harm
    bits = int(rank.max(initial=0)).bit_length()
    less, below, above = np.zeros(n, np.int64), np.full(n, -np.inf), np.full(n, np.inf)
    # sorted once; equal values: the later first, so in every block its upper half and ties are not below
    by = np.lexsort((-rank, value, group))
    rank, value, block = rank[by], value[by], group[by].astype(np.int64)
    block = np.cumsum(np.append(0, block[1:] != block[:-1])) if n else block
    for bit in reversed(range(bits)):
        half = (rank >> bit) & 1 == 1
        count = np.cumsum(~half)  # lower rows up to here
        start = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        ends = np.append(start[1:], n) - 1
        here = np.repeat(np.arange(len(start)), ends - start + 1)
        first, last = (count - ~half)[start][here], count[ends][here]  # lower rows before and up to the end of the block
        low = value[~half]
        upper = np.flatnonzero(half)
        k, a, z = count[upper], first[upper], last[upper]
        mine = by[upper]
        less[mine] += k - a
        has = k > a
        at = mine[has]
        below[at] = np.maximum(below[at], low[k[has] - 1])
        has = k < z
        at = mine[has]
        above[at] = np.minimum(above[at], low[k[has]])
        # the next blocks: the lower half of each before its upper half, both in the order of values
        count_upper = np.cumsum(half)
        to = np.where(half, last + count_upper - 1, first + count - first - 1 + (count_upper - half)[start][here])
        moved = np.empty(n, np.int64)
        moved[to] = np.arange(n)
        block = (block * 2 + half)[moved]
        block = np.cumsum(np.append(0, block[1:] != block[:-1]))
        rank, value, by = rank[moved], value[moved], by[moved]
    return seen, less, np.where(np.isinf(below), np.nan, below), np.where(np.isinf(above), np.nan, above)


def _compared(rows: DataFrame, bucket: str, order: str, prefix: str, width: int) -> DataFrame:
    """Rows with the four columns of :func:`earlier_order` within each (group, bucket); single-value buckets
    (odd numbers) get none.  ``width`` is above all bucket numbers."""
    names = [f"{prefix}_seen", f"{prefix}_less", f"{prefix}_below", f"{prefix}_above"]
    types = ["long", "long", "double", "double"]
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields]
                    + [f"{n} {t}" for n, t in zip(names, types, strict=True)])
    arrow = [pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def with_order(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        n = t.num_rows
        new = np.zeros(n, bool)
        key = t.column("key").to_numpy()
        new[1:] = key[1:] != key[:-1]
        t = t.drop_columns("key")
        some = np.flatnonzero(t.column(bucket).to_numpy() % 2 == 0)
        found = [np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, np.nan), np.full(n, np.nan)]
        if len(some):
            parts = earlier_order(np.cumsum(new)[some], t.column(order).to_numpy()[some], t.column("value").to_numpy()[some])
            for whole, part in zip(found, parts, strict=True):
                whole[some] = part
        for name, v, kind in zip(names, found, arrow, strict=True):
            t = t.append_column(name, pa.array(v, kind, from_pandas=True))
        yield from t.to_batches(max_chunksize=10000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # whole groups, and the last one as far as it was read
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            if sum(x.num_rows for x in held) < HELD_ROWS:
                continue
            key = b.column(b.num_columns - 1).to_numpy()
            cut = int(np.searchsorted(key, key[-1]))  # where the last group begins in this batch
            if cut:
                yield from with_order([*held[:-1], b.slice(0, cut)])
                held = [b.slice(cut)]
        if held:
            yield from with_order(held)

    # group and bucket in one number: rows are sorted by it alone
    rows = rows.withColumn("key", F.col(ID) * width + F.col(bucket))
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, ddl)


def earlier_values(values: DataFrame) -> DataFrame:
    """(study, number, step, value, n_before, n_less, below, above) of every row with a value: how
    many earlier trials reported the step, how many of them less, and the neighbours of the value."""
    v = values.select(F.col("study").cast("string").alias("study"), F.col("number").cast("bigint").alias("number"),
                      F.col("step").cast("int").alias("step"), F.col("value").cast("double").alias("value"))
    v = v.where(F.col("value").isNotNull() & ~F.isnan("value"))
    groups = v.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n")).withColumn(ID, F.monotonically_increasing_id())
    groups = stored(groups, "pruning-groups")  # written, so that every reader sees the same numbers
    size = groups.agg(F.max("n"), F.count(F.lit(1))).first()
    groups = groups.drop("n")
    v = v.join(groups, GROUP).select(ID, "number", "value")
    buckets = max(2, int(np.sqrt(size[0] or 1) / 4))
    ranged, _ = bucketize(v.withColumn("_v", F.col("number").cast("double")), [ID], buckets, size[1], least=2)
    ranged = ranged.withColumnRenamed("_bk", "range").withColumn("_v", F.col("value"))
    rows, _ = bucketize(ranged, [ID], buckets, size[1], least=2)
    rows = rows.withColumnRenamed("_bk", "bucket").select(ID, "number", "value", F.col("range").cast("int").alias("range"),
                                                          F.col("bucket").cast("int").alias("bucket"))
    rows = _compared(rows, "range", "number", "r", 2 * buckets + 2)
    rows = _compared(rows, "bucket", "range", "b", 2 * buckets + 2)
    rows = rows.select(ID, "number", "value", "range", "bucket", "r_seen", (F.col("r_less") + F.col("b_less")).alias("less"),
                       F.greatest("r_below", "b_below").alias("below"), F.least("r_above", "b_above").alias("above"))
    rows = stored(rows, "pruning-rows")  # read for the counts and again for the rows

    cells = rows.groupBy(ID, "range", "bucket").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("hi"), F.min("value").alias("lo"))
    # every range with every bucket of its group: about as many cells as rows
    grid = cells.select(ID, "range").distinct().join(cells.select(ID, "bucket").distinct(), ID)
    grid = grid.join(cells, [ID, "range", "bucket"], "left")
    before = Window.partitionBy(ID, "bucket").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.select(ID, "range", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n"),
                       F.max("hi").over(before).alias("hi"), F.min("lo").over(before).alias("lo"))
    across = Window.partitionBy(ID, "range").orderBy("bucket")
    lower = across.rowsBetween(Window.unboundedPreceding, -1)
    higher = across.rowsBetween(1, Window.unboundedFollowing)
    grid = grid.select(ID, "range", "bucket", F.sum("n").over(Window.partitionBy(ID, "range")).alias("g_seen"),
                       F.coalesce(F.sum("n").over(lower), F.lit(0)).alias("g_less"), F.max("hi").over(lower).alias("g_below"),
                       F.min("lo").over(higher).alias("g_above"),
                       F.when(F.col("bucket") % 2 == 1, F.col("lo")).alias("g_same"))  # earlier rows of a single-value bucket
    out = rows.join(grid, [ID, "range", "bucket"]).join(groups, ID)
    return out.select("study", "number", "step", "value", (F.col("g_seen") + F.col("r_seen")).alias("n_before"),
                      (F.col("g_less") + F.col("less")).alias("n_less"), F.greatest("g_below", rows["below"]).alias("below"),
                      F.least("g_above", "g_same", rows["above"]).alias("above"))


def median_prune(values: DataFrame, n_startup: int = 10, n_warmup: int = 0) -> DataFrame:
    """W10 (audit form): (study, number, prune_step, last_step); ``prune_step`` is the first step >=
    ``n_warmup`` with at least ``n_startup`` earlier values whose median the trial's value
    exceeds.  Missing values are neither compared nor flagged; trials that share a number do not see each other."""
    e = earlier_values(values)
    m, less = F.col("n_before"), F.col("n_less")
    worse = F.when(m % 2 == 1, less * 2 > m).otherwise(
        (less * 2 > m) | ((less * 2 == m) & (F.col("value") > (F.col("below") + F.col("above")) / 2)))
    flagged = (e.where((m >= n_startup) & (F.col("step") >= n_warmup) & (m > 0) & worse)
               .groupBy("study", "number").agg(F.min("step").alias("prune_step")))
    last = values.groupBy(F.col("study").cast("string").alias("study"), F.col("number").cast("bigint").alias("number")).agg(
        F.max(F.col("step").cast("int")).alias("last_step"))
    return last.join(flagged, ["study", "number"], "left").select("study", "number", "prune_step", "last_step")
