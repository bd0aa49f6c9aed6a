"""Exact-size deterministic splits.

The reference shuffles rows with a seeded permutation and cuts the shuffled list at
fixed positions.  We order rows by ``md5(key:seed)`` instead, which any engine can
recompute, and assign labels by rank.  A global ``row_number`` would push every row
through one task, so the rank is obtained in two cheap steps:

1. count rows per hash bucket (the first ``digits`` hex digits, 16**digits buckets;
   a partial aggregate, at most 65 536 rows reach the driver);
2. buckets lying wholly inside one split get their label from a literal range test
   (no shuffle); only the few buckets that contain a cut point are ranked exactly
   with a window partitioned by bucket.

Rows are therefore never sorted globally, the cut rows are exact, and a lost
executor recomputes the same labels because everything is a function of the key.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from respan.functions.hashing import hash_bucket, hash_hex

SizesFn = Callable[[int], Sequence[int]]


def sizes_70_15_15(n: int) -> list[int]:
    """train_test_split(train=0.7) then the rest halved (val = floor(rest/2))."""
    n_train = math.floor(0.7 * n)
    rest = n - n_train
    n_val = math.floor(0.5 * rest)
    return [n_train, n_val, rest - n_val]


def sizes_timeseries(n: int) -> list[int]:
    """Cuts at int(0.7n) and int(0.7n)+int(0.15n), the remainder is test."""
    a = int(n * 0.7)
    b = int(n * 0.15)
    return [a, b, n - a - b]


def sizes_80_10_10(n: int) -> list[int]:
    """test_size=0.2 (ceil) then test_size=0.5 of the rest; order train, test, val."""
    n_temp = math.ceil(0.2 * n)
    n_val = math.ceil(0.5 * n_temp)
    return [n - n_temp, n_temp - n_val, n_val]


def sizes_90_10(n: int) -> list[int]:
    n_val = int(0.1 * n)
    return [n - n_val, n_val]


SPLIT_LAYOUTS: dict[str, tuple[SizesFn, tuple[str, ...]]] = {
    "70_15_15": (sizes_70_15_15, ("train", "val", "test")),
    "timeseries": (sizes_timeseries, ("train", "val", "test")),
    "80_10_10": (sizes_80_10_10, ("train", "test", "val")),
    "90_10": (sizes_90_10, ("train", "val")),
}


def _bucket_counts(df: DataFrame, digits: int) -> list[tuple[int, int]]:
    rows = df.groupBy("_b").agg(F.count(F.lit(1)).alias("n")).collect()
    return sorted((r["_b"], r["n"]) for r in rows)


def exact_split(df: DataFrame, keys: Sequence[str], layout: str = "70_15_15", seed: int = 42,
                out_col: str = "split", digits: int = 4) -> DataFrame:
    """Label every row of ``df`` with a split name; split sizes are exact.

    Rank order is (md5(keys:seed), keys); labels follow ``SPLIT_LAYOUTS[layout]``.
    """
    sizes_fn, labels = SPLIT_LAYOUTS[layout]
    keyed = df.withColumn("_h", hash_hex(*keys, seed=seed))
    keyed = keyed.withColumn("_b", hash_bucket(F.col("_h"), digits))
    counts = _bucket_counts(keyed, digits)
    n = sum(c for _, c in counts)
    sizes = list(sizes_fn(n))
    bounds = []  # cumulative end rank (exclusive) per label
    acc = 0
    for s in sizes:
        acc += s
        bounds.append(acc)

    # label per bucket: a label index when the whole bucket falls inside one split,
    # else the bucket is a boundary bucket and is ranked exactly
    bucket_label: dict[int, int] = {}
    boundary: dict[int, int] = {}  # bucket -> rank offset
    start = 0
    for b, c in counts:
        end = start + c
        first = next(i for i, ub in enumerate(bounds) if start < ub) if start < n else len(bounds) - 1
        last = next(i for i, ub in enumerate(bounds) if end - 1 < ub) if end > 0 else first
        if first == last:
            bucket_label[b] = first
        else:
            boundary[b] = start
        start = end

    def label_of_index(idx_col):
        expr = None
        for i, name in enumerate(labels):
            expr = F.when(idx_col == i, F.lit(name)) if expr is None else expr.when(idx_col == i, F.lit(name))
        return expr

    # bucket ranges with the same label are contiguous; express them as range tests
    ranges: list[tuple[int, int, int]] = []  # (lo, hi, label)
    for b, lab in sorted(bucket_label.items()):
        # labels are monotone in bucket order, so empty buckets between two buckets of
        # the same label belong to that label as well: at most one range per label
        if ranges and ranges[-1][2] == lab:
            ranges[-1] = (ranges[-1][0], b, lab)
        else:
            ranges.append((b, b, lab))
    idx = None
    for lo, hi, lab in ranges:
        cond = F.col("_b").between(lo, hi)
        idx = F.when(cond, F.lit(lab)) if idx is None else idx.when(cond, F.lit(lab))
    idx = idx if idx is not None else F.lit(None).cast("int")

    plain = keyed.where(~F.col("_b").isin(list(boundary))) if boundary else keyed
    plain = plain.withColumn(out_col, label_of_index(idx))
    if not boundary:
        return plain.drop("_h", "_b")

    # rows of the few boundary buckets are ranked to find the hashes that begin each split
    # (and those before them); a label is then a comparison with literals
    w = Window.partitionBy("_b").orderBy("_h", *keys)
    cuts = [ub for ub in bounds[:-1] if 0 < ub < n]
    want = [(b, ub - off) for ub in cuts for b, off, end in _spans(counts) if off <= ub < end]
    wanted = {(b, r) for b, k in want for r in (k - 1, k)}
    edge = (keyed.where(F.col("_b").isin(sorted({b for b, _ in want}))).withColumn("_r", F.row_number().over(w) - 1)
            .where(F.struct("_b", "_r").isin([F.struct(F.lit(b), F.lit(r)) for b, r in sorted(wanted)]))
            .select("_b", "_r", "_h").collect())
    found = {(r["_b"], r["_r"]): r["_h"] for r in edge}
    if all(found.get((b, k - 1)) != found[b, k] for b, k in want):
        expr = F.lit(labels[-1])
        for (b, k), ub in sorted(zip(want, cuts, strict=True), key=lambda p: -p[1]):
            # of equal bounds (an empty split) the later label never applies
            expr = F.when(F.col("_h") < found[b, k], F.lit(labels[bounds.index(ub)])).otherwise(expr)
        return keyed.withColumn(out_col, expr).drop("_h", "_b")

    # equal keys stand on both sides of a cut: rank those buckets' rows one by one
    offsets = F.create_map(*[x for b, off in boundary.items() for x in (F.lit(b), F.lit(off))])
    ranked = keyed.where(F.col("_b").isin(list(boundary)))
    ranked = ranked.withColumn("_rank", F.element_at(offsets, F.col("_b")) + F.row_number().over(w) - 1)
    ridx = None
    for i, ub in enumerate(bounds):
        ridx = F.when(F.col("_rank") < ub, F.lit(i)) if ridx is None else ridx.when(F.col("_rank") < ub, F.lit(i))
    ranked = ranked.withColumn(out_col, label_of_index(ridx)).drop("_rank")
    return plain.unionByName(ranked).drop("_h", "_b")


def _spans(counts: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(bucket, first rank, end rank) of each bucket."""
    out, start = [], 0
    for b, c in counts:
        out.append((b, start, start + c))
        start += c
    return out


def split_sql(table: str, keys: Sequence[str], layout: str = "70_15_15", seed: int = 42,
              out_col: str = "split") -> str:
    """DuckDB twin (global row_number) used as the oracle for :func:`exact_split`."""
    from respan.functions.hashing import sql_hash_hex

    h = sql_hash_hex(*keys, seed=seed)
    order = ", ".join([h] + list(keys))
    n = "count(*) OVER ()"
    rk = f"row_number() OVER (ORDER BY {order}) - 1"
    if layout == "70_15_15":
        c1 = f"floor(0.7::DOUBLE * {n})"
        c2 = f"{c1} + floor(0.5::DOUBLE * ({n} - {c1}))"
        case = f"CASE WHEN _rk < _c1 THEN 'train' WHEN _rk < _c2 THEN 'val' ELSE 'test' END"
    elif layout == "timeseries":
        c1 = f"floor({n} * 0.7::DOUBLE)"
        c2 = f"{c1} + floor({n} * 0.15::DOUBLE)"
        case = f"CASE WHEN _rk < _c1 THEN 'train' WHEN _rk < _c2 THEN 'val' ELSE 'test' END"
    elif layout == "80_10_10":
        t = f"ceil(0.2::DOUBLE * {n})"
        c1 = f"({n} - {t})"
        c2 = f"{c1} + ({t} - ceil(0.5::DOUBLE * {t}))"
        case = f"CASE WHEN _rk < _c1 THEN 'train' WHEN _rk < _c2 THEN 'test' ELSE 'val' END"
    elif layout == "90_10":
        c1 = f"({n} - floor(0.1::DOUBLE * {n}))"
        c2 = n
        case = f"CASE WHEN _rk < _c1 THEN 'train' ELSE 'val' END"
    else:
        raise ValueError(layout)
    return (f"SELECT * EXCLUDE (_rk, _c1, _c2), {case} AS {out_col} FROM "
            f"(SELECT *, {rk} AS _rk, {c1} AS _c1, {c2} AS _c2 FROM {table})")
