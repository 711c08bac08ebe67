"""Deterministic hashing used for every random choice in the library.

``H(seed, salt, id)`` is the first 32 bits of ``md5('seed|salt|id')`` as a
BIGINT in [0, 2**32). It depends only on the values, never on partitioning,
so results are identical under any number of partitions, and DuckDB computes
the same value with ``sql_hash``. Spark's ``rand()`` is never used.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO32 = 4294967296


def _as_col(x) -> Column:
    if isinstance(x, Column):
        return x.cast("string")
    if isinstance(x, str) and x.startswith("col:"):
        return F.col(x[4:]).cast("string")
    return F.lit(str(x))


def H(seed, salt, *ids) -> Column:
    """Hash of (seed, salt, ids...). ``seed``/``ids`` may be Columns, column
    names prefixed ``col:``, or literals; ``salt`` is usually a literal."""
    parts = [_as_col(seed), _as_col(salt)] + [_as_col(i) for i in ids]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("bigint")


def uniform(seed, salt, *ids) -> Column:
    """Hash mapped to [0, 1)."""
    return H(seed, salt, *ids) / F.lit(float(TWO32))


def sql_hash(seed: str, salt: str, *ids: str) -> str:
    """DuckDB text of ``H``; arguments are SQL expressions."""
    parts = ", ".join(f"CAST({p} AS VARCHAR)" for p in (seed, salt) + ids)
    return f"CAST(('0x' || substr(md5(concat_ws('|', {parts})), 1, 8)) AS BIGINT)"


def py_hash(seed, salt, *ids) -> int:
    """Driver-side twin of ``H`` for bounded lists (heavy groups)."""
    import hashlib
    s = "|".join(str(x) for x in (seed, salt) + ids)
    return int(hashlib.md5(s.encode("utf-8")).hexdigest()[:8], 16)
