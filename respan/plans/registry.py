"""Registry of named queries: a Spark builder and (when SQL can express it) a DuckDB twin.

Each builder takes ``(spark, sf_dir)`` and returns a DataFrame over the generated
tables (or fixtures Spark derives from them).  ``finish`` normalises doubles for
value comparison (6 decimals, no negative zero); the SQL twins do the same with
:func:`r6`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def quantize(c):
    """Engine-independent 6-decimal form: first snap to 1e-9 (absorbs last-bit noise
    from a different summation order), then round half away from zero to 1e-6 using
    only IEEE multiply/divide and integer rounding, which Spark and DuckDB share."""
    q9 = F.round(c.cast("double") * F.lit(1e9)) / F.lit(1e9)
    return F.round(q9 * F.lit(1e6)) / F.lit(1e6) + F.lit(0.0)


def finish(df: DataFrame) -> DataFrame:
    """Quantize floating columns and turn -0.0 into 0.0 (comparison form)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            cols.append(quantize(F.col(f"`{f.name}`")).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def r6(expr: str, alias: str | None = None) -> str:
    s = f"(round(round(CAST({expr} AS DOUBLE) * 1e9) / 1e9 * 1e6) / 1e6 + 0.0)"
    return f"{s} AS {alias}" if alias else s
