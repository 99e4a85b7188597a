"""Deterministic row hash shared by splits, folds, sampling and masking.

``stable_hash(seed, key)`` = first 32 bits of md5("<seed>:<key>") as BIGINT.
The same value comes out of SQL engines that have md5 and hex parsing, so a
split made here can be reproduced elsewhere, and it does not depend on
partitioning, task order or executor count.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_RANGE = 1 << 32  # stable_hash values lie in [0, 2**32)


def _key(*keys) -> Column:
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    parts = []
    for i, c in enumerate(cols):
        if i:
            parts.append(F.lit(":"))
        parts.append(c.cast("string"))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def stable_hash(seed, *keys) -> Column:
    """BIGINT in [0, 2^32): md5 of ``seed:key1:key2...`` cut to 8 hex digits."""
    s = F.concat(F.lit(f"{seed}:"), _key(*keys))
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("bigint")


def stable_uniform(seed, *keys) -> Column:
    """Uniform double in [0, 1) from :func:`stable_hash`."""
    return stable_hash(seed, *keys) / F.lit(float(HASH_RANGE))


def stable_hash_sql(seed, *exprs: str) -> str:
    """The same hash as SQL text (DuckDB dialect), for oracle queries."""
    inner = " || ':' || ".join(f"CAST({e} AS VARCHAR)" for e in exprs)
    return f"CAST(('0x' || substr(md5('{seed}:' || {inner}), 1, 8)) AS BIGINT)"
