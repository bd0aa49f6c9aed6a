"""Exact, linearly interpolated percentiles without a one-task group.

``percentile`` in Spark is exact but keeps a value->count map per group and merges
it in a single task, which does not scale to a group holding billions of distinct
values.  ``percentile_approx`` scales but is approximate.  This module combines
them (the numpy/DuckDB ``quantile_cont`` definition is reproduced exactly):

1. per group: a bounded ``percentile_approx`` sketch gives ``B-1`` bucket edges
   (1024 buckets, fewer only if there are very many groups), and the row count ``n``;
2. each row gets its bucket (number of edges strictly below the value, found by
   halving; a value equal to an edge gets its own point-mass bucket);
   per (group, bucket) we count rows and keep min/max -> at most G*2B small rows;
3. for every requested probability the two neighbouring ranks
   ``floor(p(n-1))`` and ``ceil(p(n-1))`` are located in a bucket from the
   running counts;
4. a target bucket whose min equals its max (a tie block, e.g. a value holding a
   third of the rows) answers from its min without touching the rows; the other target
   buckets (about n / 1024 rows each) are ranked with a window partitioned by (group, bucket).

The path is the same at every size.  The edge table has one row per group; it is broadcast
because its size (groups x buckets) is checked against a bound, beyond which the planner
chooses the join.
For tiny groups (bootstrap replicates, fold scores) call ``F.percentile`` directly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS, LEAST = 1024, 64
#: Edges (doubles) of all groups together that may be broadcast: 32 MB.
BROADCAST_EDGES = 1 << 22


def bucketize(data: DataFrame, groups: list[str], buckets: int, n_groups: int, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Rows (value ``_v``) with their bucket ``_bk``, odd for a single value, and per-bucket stats with running [start, end) ranks."""
    buckets = max(least, min(buckets, BROADCAST_EDGES // max(n_groups, 1)))
    # one string literal instead of thousands keeps the plan small
    probs = ",".join(repr(i / buckets) for i in range(1, buckets))
    edges = data.groupBy(*groups).agg(
        F.expr(f"percentile_approx(_v, cast(split('{probs}', ',') as array<double>), {4 * buckets})").alias("_e"))
    if n_groups * buckets <= BROADCAST_EDGES:
        edges = F.broadcast(edges)
    rows = data.join(edges, groups, "inner")  # one edge row per group
    # edges are sorted: those below the value are counted by halving (past their end there is null, which is not below)
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(buckets.bit_length()))])
    rows = rows.withColumn("_c", F.aggregate(steps, F.lit(0), lambda c, s: c + F.when(F.get("_e", c + s - 1) < F.col("_v"), s).otherwise(0)))
    same = F.coalesce(F.get("_e", F.col("_c")) == F.col("_v"), F.lit(False))
    bucketed = rows.withColumn("_bk", F.col("_c") * 2 + F.when(same, 1).otherwise(0)).drop("_e", "_c")
    stats = (bucketed.groupBy(*groups, "_bk")
             .agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")))
    w = Window.partitionBy(*groups).orderBy("_bk")  # at most 2 * buckets rows a group
    stats = stats.withColumn("_end", F.sum("_c").over(w)).withColumn("_start", F.col("_end") - F.col("_c"))
    return bucketed, stats


def _select_ranks(data: DataFrame, groups: list[str], ranks: DataFrame, buckets: int, n_groups: int) -> DataFrame:
    """Values at 0-based ranks ``_r`` within each group: (groups..., _r, _val)."""
    bucketed, stats = bucketize(data, groups, buckets, n_groups)
    located = ranks.join(stats, groups, "inner").where((F.col("_r") >= F.col("_start")) & (F.col("_r") < F.col("_end")))
    point = located.where(F.col("_lo") == F.col("_hi")).select(*groups, "_r", F.col("_lo").alias("_val"))
    need = located.where(F.col("_lo") != F.col("_hi")).select(*groups, "_bk", "_start", "_r")
    need_b = need.select(*groups, "_bk", "_start").distinct()
    rows = bucketed.select(*groups, "_bk", "_v").join(need_b, groups + ["_bk"], "inner")
    wr = Window.partitionBy(*groups, "_bk").orderBy("_v")
    rows = rows.withColumn("_r", F.col("_start") + F.row_number().over(wr) - 1)
    picked = (rows.join(need.select(*groups, "_bk", "_r").distinct(), groups + ["_bk", "_r"], "inner")
              .select(*groups, "_r", F.col("_v").alias("_val")))
    return point.distinct().unionByName(picked)


def exact_percentiles(df: DataFrame, value: str, probs: Sequence[float], groups: Sequence[str] = (),
                      buckets: int = BUCKETS, names: Sequence[str] | None = None) -> DataFrame:
    """One row per group with one column per probability (default names ``p_<i>``).

    Null (and NaN) values are ignored; groups with no value are absent.
    """
    names = list(names) if names is not None else [f"p_{i}" for i in range(len(probs))]
    user_groups = list(groups)
    groups = user_groups or ["_g"]
    data = df.select(*user_groups, F.col(value).cast("double").alias("_v"))
    if not user_groups:
        data = data.withColumn("_g", F.lit(0))
    data = data.where(F.col("_v").isNotNull() & ~F.isnan("_v"))

    counts = data.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"))
    targets = F.explode(F.array(*[
        F.struct(F.lit(i).alias("pi"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)]))
    tg = (counts.select(*groups, "_n", targets.alias("_t"))
          .select(*groups, "_n", F.col("_t.pi").alias("_pi"), F.col("_t.p").alias("_p"))
          .withColumn("_pos", F.col("_p") * (F.col("_n") - 1))
          .withColumn("_r_lo", F.floor("_pos")).withColumn("_r_hi", F.ceil("_pos")))
    ranks = tg.select(*groups, F.explode(F.array("_r_lo", "_r_hi")).alias("_r")).distinct()
    values = _select_ranks(data, groups, ranks, buckets, counts.count() if user_groups else 1)

    out = tg.join(values.withColumnRenamed("_r", "_r_lo").withColumnRenamed("_val", "_v_lo"),
                  groups + ["_r_lo"], "inner")
    out = out.join(values.withColumnRenamed("_r", "_r_hi").withColumnRenamed("_val", "_v_hi"),
                   groups + ["_r_hi"], "inner")
    frac = F.col("_pos") - F.col("_r_lo")
    out = out.withColumn("_q", F.col("_v_lo") + (F.col("_v_hi") - F.col("_v_lo")) * frac)
    pivoted = out.groupBy(*groups).agg(*[
        F.max(F.when(F.col("_pi") == i, F.col("_q"))).alias(name) for i, name in enumerate(names)])
    return pivoted if user_groups else pivoted.drop("_g")


def sql_quantile(value: str, p: float) -> str:
    return f"quantile_cont({value}, {p!r}::DOUBLE)"
