"""Hashes that every engine computes alike, built on md5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(key: Column, seed: int | str) -> Column:
    """32 hex digits of key and seed; null for a null key. Also a portable sort key."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")))


def hash60(key: Column, seed: int | str) -> Column:
    """A uniform bigint in [0, 2**60)."""
    return F.conv(F.substring(digest(key, seed), 1, 15), 16, 10).cast("bigint")


def bucket(key: Column, seed: int | str, buckets: int) -> Column:
    """A uniform bucket in [0, buckets)."""
    return hash60(key, seed) % buckets


def digest_sql(key: str, seed: int | str) -> str:
    """`digest` for DuckDB."""
    return f"md5(CAST({key} AS VARCHAR) || '|{seed}')"


def hash60_sql(key: str, seed: int | str) -> str:
    """`hash60` for DuckDB."""
    return f"('0x' || substr({digest_sql(key, seed)}, 1, 15))::BIGINT"


def bucket_sql(key: str, seed: int | str, buckets: int) -> str:
    """`bucket` for DuckDB."""
    return f"({hash60_sql(key, seed)} % {buckets})"
