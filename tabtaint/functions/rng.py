"""Seeded, partition-independent randomness.

A draw is a pure function of ``md5(seed ':' tag ':' key)``: the same row gets the same
number whatever the partitioning, the executor or a task retry.  ``F.rand(seed)`` is not
used because it depends on the partition layout.

Uniform  = first 13 hex chars as a 52-bit integer / 2^52  (in [0, 1)).
Normal   = Box-Muller on hex chars 1-13 and 14-26.
Each helper has an SQL twin (``sql_*``) producing the same numbers in DuckDB, used by the
oracle queries.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO52 = 4503599627370496.0


def _lit_prefix(seed, tag) -> str:
    return f"{seed}:{tag}:"


def hash_hex(seed, tag: str, key) -> Column:
    """md5 hex of ``seed:tag:key`` (key: column or column name)."""
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(_lit_prefix(seed, tag)), k.cast("string")))


def uniform_of(h: Column) -> Column:
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("bigint") / F.lit(TWO52)


def normal_of(h: Column) -> Column:
    u1 = F.conv(F.substring(h, 1, 13), 16, 10).cast("bigint")
    u2 = F.conv(F.substring(h, 14, 13), 16, 10).cast("bigint")
    return F.sqrt(F.lit(-2.0) * F.log((u1 + 1) / F.lit(TWO52 + 1))) * F.cos(F.lit(2 * math.pi) * u2 / F.lit(TWO52))


def uniform(seed, tag: str, key) -> Column:
    return uniform_of(hash_hex(seed, tag, key))


def normal(seed, tag: str, key) -> Column:
    return normal_of(hash_hex(seed, tag, key))


# ---- driver-side twins for metadata decisions (column choice, factors) ----

def py_hash(seed, tag: str, key) -> str:
    return hashlib.md5(f"{seed}:{tag}:{key}".encode("utf-8")).hexdigest()


def py_uniform(seed, tag: str, key) -> float:
    return int(py_hash(seed, tag, key)[:13], 16) / TWO52


def py_sample(elements, how_many: int, seed, tag: str) -> list:
    """Exact-k sample of a small list (column names, scale factors): the k smallest hashes.

    Empty input gives []; asking for at least the length gives every element (in hash order).
    """
    elements = list(elements)
    order = sorted(elements, key=lambda e: py_hash(seed, tag, e))
    return order[: max(int(how_many), 0)]


def py_choice(elements, seed, tag: str, key=""):
    elements = list(elements)
    return elements[int(py_uniform(seed, tag, key) * len(elements))]


# ---- SQL (DuckDB) twins for the oracle ----

def sql_hash(seed, tag: str, key_sql: str) -> str:
    return f"md5('{_lit_prefix(seed, tag)}' || CAST({key_sql} AS VARCHAR))"


def sql_uniform_of(h_sql: str) -> str:
    return f"(CAST(('0x' || substr({h_sql}, 1, 13)) AS BIGINT) / 4503599627370496.0)"


def sql_normal_of(h_sql: str) -> str:
    u1 = f"CAST(('0x' || substr({h_sql}, 1, 13)) AS BIGINT)"
    u2 = f"CAST(('0x' || substr({h_sql}, 14, 13)) AS BIGINT)"
    return (f"(sqrt(-2.0 * ln(({u1} + 1) / 4503599627370497.0)) * "
            f"cos({2 * math.pi!r} * {u2} / 4503599627370496.0))")


def sql_uniform(seed, tag, key_sql) -> str:
    return sql_uniform_of(sql_hash(seed, tag, key_sql))


def sql_normal(seed, tag, key_sql) -> str:
    return sql_normal_of(sql_hash(seed, tag, key_sql))
