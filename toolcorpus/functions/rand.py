"""Seeded, partition-independent randomness.

``stable_hash(seed, salt, id, ...)`` draws a uniform integer in [0, 2^32) from
the first 8 hex digits of ``md5(concat_ws('|', parts))``. The draw depends only
on the row's own key, never on row order or partitioning, so it is retry-safe
and gives the same value in Spark and in any SQL engine with ``md5``.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

HASH_RANGE = 1 << 32


def stable_hash(*parts) -> Column:
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    cols = [c.cast("string") for c in cols]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 8), 16, 10).cast("bigint")
