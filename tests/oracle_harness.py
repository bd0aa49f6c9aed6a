"""Local twin of the driver's correctness gate: run a registered Spark query and its
DuckDB oracle on the same Parquet tables and compare row count, column names and an
order-insensitive hash of the values."""

from __future__ import annotations

import hashlib
import math
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

from respan.catalog import BASE_TABLES  # noqa: E402


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or v is pd.NA:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        return repr(v + 0.0)
    if hasattr(v, "item"):
        v = v.item()
        return _norm(v)
    if isinstance(v, (pd.Timestamp,)):
        return str(v.to_pydatetime())
    return str(v)


def frame_hash(df: pd.DataFrame) -> tuple[int, list[str], str]:
    cols = sorted(df.columns)
    rows = sorted("|".join(_norm(r[c]) for c in cols) for r in df[cols].to_dict("records"))
    return len(rows), cols, hashlib.md5("\n".join(rows).encode()).hexdigest()


def compare(spark, name: str, sf_dir: str, verbose: bool = True):
    import __spark_entry__ as E

    t0 = time.time()
    sdf = E.queries()[name](spark, sf_dir)
    spd = sdf.toArrow().to_pandas(integer_object_nulls=True, timestamp_as_object=False)  # null integers stay integers
    t1 = time.time()
    sql = E.oracle_sql().get(name)
    if sql is None:
        return {"name": name, "rows": len(spd), "oracle": None, "spark_s": round(t1 - t0, 2)}
    dpd = duck(sf_dir).execute(sql).df()
    a, b = frame_hash(spd), frame_hash(dpd)
    ok = a == b
    res = {"name": name, "ok": ok, "rows": (a[0], b[0]), "cols_ok": a[1] == b[1], "spark_s": round(t1 - t0, 2)}
    if not ok and verbose:
        res["spark_cols"] = a[1]
        res["duck_cols"] = b[1]
        cols = sorted(set(spd.columns) & set(dpd.columns))
        sa = sorted("|".join(_norm(r[c]) for c in cols) for r in spd[cols].to_dict("records"))
        sb = sorted("|".join(_norm(r[c]) for c in cols) for r in dpd[cols].to_dict("records"))
        diff_a = [x for x in sa if x not in set(sb)][:3]
        diff_b = [x for x in sb if x not in set(sa)][:3]
        res["cols"] = cols
        res["only_spark"] = diff_a
        res["only_duck"] = diff_b
    return res


if __name__ == "__main__":
    from respan.session import get_spark
    import __spark_entry__ as E

    sf = "/root/testdata/sf0.01"
    spark = get_spark("local[8]", shuffle_partitions=8)
    names = sys.argv[1:] or list(E.queries())
    bad = 0
    for n in names:
        try:
            r = compare(spark, n, sf)
        except Exception as ex:  # report and continue
            r = {"name": n, "error": repr(ex)[:800]}
        if r.get("ok") is False or "error" in r:
            bad += 1
        print(r, flush=True)
    print(f"FAILED {bad} of {len(names)}")
