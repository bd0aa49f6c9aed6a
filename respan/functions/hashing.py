"""Deterministic, engine-portable pseudo-randomness.

Every random choice in the library (shuffled splits, bootstrap weights, fold
assignment, search sampling) is a pure function of a row key and a seed, so a
recomputed partition after an executor loss yields the same rows, and the same
numbers can be reproduced by any SQL engine that has ``md5``.

hash_hex(k1, k2, ..., seed)  = md5("k1:k2:...:seed")
uniform(hex)                 = int(first 8 hex digits, 16) / 2**32   in [0, 1)
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def _as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash_hex(*keys, seed: int = 42) -> Column:
    parts = [_as_col(k).cast("string") for k in keys] + [F.lit(str(seed))]
    return F.md5(F.concat_ws(":", *parts))


def uniform(*keys, seed: int = 42) -> Column:
    """Uniform [0,1) double derived from the key hash."""
    return uniform_of_hex(hash_hex(*keys, seed=seed))


def uniform_of_hex(hex_col: Column, offset: int = 0) -> Column:
    """Uniform from the 8 hex digits starting at ``offset`` (0-based) of a hash."""
    digits = F.substring(hex_col, offset + 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(TWO_32)


def hash_bucket(hex_col: Column, digits: int = 4) -> Column:
    """Integer bucket from the leading hex digits (16**digits buckets)."""
    return F.conv(F.substring(hex_col, 1, digits), 16, 10).cast("int")


def sql_hash_hex(*keys: str, seed: int = 42) -> str:
    """DuckDB twin of :func:`hash_hex` (for oracle SQL)."""
    parts = ", ".join([f"CAST({k} AS VARCHAR)" for k in keys] + [f"'{seed}'"])
    return f"md5(concat_ws(':', {parts}))"


def sql_uniform(*keys: str, seed: int = 42) -> str:
    return f"(CAST(('0x' || substr({sql_hash_hex(*keys, seed=seed)}, 1, 8)) AS UBIGINT) / 4294967296.0)"


# 32-bit integer mixer for per-replicate random streams (bootstrap weights).  A row
# with integer key k gets stream seed  s = mix32((k mod 2**32 + seed * GOLDEN32) mod 2**32)
# and draw r of its stream is  mix32((s + r * GOLDEN32) mod 2**32) / 2**32.  Only
# BIGINT multiply/xor/shift on values below 2**32 (products below 2**59) are used, so
# ANSI overflow cannot occur, the cost per draw is a few integer operations, and
# DuckDB reproduces every draw bit for bit.
GOLDEN32 = 2654435761
MIX32_MULT = 73244475  # 0x45d9f3b
MOD32 = 4294967296


def _mix_steps(df, x: str):
    # each step is its own projection: a step reads its input twice, and nesting the
    # steps in one expression would duplicate the tree 2**steps times
    for step in range(3):
        df = df.withColumn(x, F.col(x).bitwiseXOR(F.shiftright(F.col(x), 16)))
        if step < 2:
            df = df.withColumn(x, (F.col(x) * F.lit(MIX32_MULT)) % F.lit(MOD32))
    return df


def with_stream_seed(df, key_col: str, seed: int = 42, out: str = "_s"):
    """Add the 32-bit stream seed of an integer key."""
    df = df.withColumn(out, (F.pmod(F.col(key_col).cast("bigint"), F.lit(MOD32)) + F.lit(seed * GOLDEN32 % MOD32))
                       % F.lit(MOD32))
    return _mix_steps(df, out)


def with_stream_uniform(df, seed_col: str, index_col: str, out: str = "_u"):
    """Add uniform [0,1) for draw ``index_col`` of the stream seeded by ``seed_col``."""
    x = "_mx"
    df = df.withColumn(x, (F.col(seed_col) + F.col(index_col).cast("bigint") * F.lit(GOLDEN32)) % F.lit(MOD32))
    df = _mix_steps(df, x)
    return df.withColumn(out, F.col(x).cast("double") / F.lit(TWO_32)).drop(x)


def _sql_mix(x: str) -> str:
    for step in range(3):
        x = f"xor({x}, ({x}) >> 16)"
        if step < 2:
            x = f"(({x}) * {MIX32_MULT}) % {MOD32}"
    return x


def sql_stream_seed(key_sql: str, seed: int = 42) -> str:
    m = MOD32
    return _sql_mix(f"(((({key_sql}) % {m} + {m}) % {m} + {seed * GOLDEN32 % m}) % {m})")


def sql_stream_uniform(seed_sql: str, index_sql: str) -> str:
    x = f"(({seed_sql} + CAST({index_sql} AS BIGINT) * {GOLDEN32}) % {MOD32})"
    return f"(CAST({_sql_mix(x)} AS DOUBLE) / 4294967296.0)"
