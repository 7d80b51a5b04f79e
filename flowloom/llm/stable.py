"""Problem 1: a sample that is the same on every run and only grows with the data.

Keys are assigned for good to many fine buckets by hash, and the buckets are ranked by a fixed permutation. A sample of
share s takes the first s x BUCKETS ranks, so a larger share only appends buckets, and new rows only join their bucket.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions import canon
from flowloom.functions.hashing import bucket, bucket_sql

BUCKETS, SEED = 4096, 20260921
# An odd factor makes x -> FACTOR * x + SHIFT a permutation of the BUCKETS residues.
FACTOR, SHIFT = 2531, 1187


def bucket_rank(b: Column) -> Column:
    """The place of a bucket in the fixed permutation."""
    return (b * FACTOR + SHIFT) % BUCKETS


def chosen_buckets(share: float) -> int:
    """How many ranks a share takes; never fewer for a larger share."""
    return min(BUCKETS, max(0, math.ceil(share * BUCKETS - 1e-9)))


def first_deliveries(deliveries: list[DataFrame]) -> DataFrame:
    """(source_row_id, key): each row id once, with the key of its first delivery, which it keeps whatever later ones say.

    The key is the flow group, or, where that is missing, the row itself. Within one delivery the smallest key stands for a
    repeated id. Rows without an id are left out, as nothing can be kept stable for them.
    """
    parts = []
    for i, d in enumerate(deliveries):
        own = F.concat(F.lit("row "), F.col("source_row_id").cast("string"))
        parts.append(d.select("source_row_id", F.struct(F.lit(i).alias("delivery"), F.coalesce(canon.group_key("flow_group_id"), own).alias("key")).alias("first")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.where("source_row_id IS NOT NULL").groupBy("source_row_id").agg(F.min("first")["key"].alias("key"))


def stable_sample(deliveries: list[DataFrame], share: float, seed: int = SEED) -> DataFrame:
    """(source_row_id, bucket): the rows of the chosen buckets, rows of one flow group together.

    `deliveries` in the order of arrival. The result depends on nothing but ids, groups, share and seed; adding a delivery or raising
    the share keeps every row chosen before. Empty tables give no rows, a share of 0 or less none, 1 or more all.
    """
    b = bucket(F.col("key"), seed, BUCKETS)
    return first_deliveries(deliveries).select("source_row_id", b.alias("bucket")).where(bucket_rank(F.col("bucket")) < chosen_buckets(share))


def stable_sample_sql(tables: list[str], share: float, seed: int = SEED) -> str:
    """The same in SQL for DuckDB."""
    key = f"coalesce({canon.group_key_sql('flow_group_id')}, 'row ' || CAST(source_row_id AS VARCHAR))"
    every = " UNION ALL ".join(f"SELECT source_row_id, {i} AS delivery, {key} AS key FROM {t}" for i, t in enumerate(tables))
    return f"""
WITH every AS ({every}),
one AS (SELECT source_row_id, first(key ORDER BY delivery, key) AS key FROM every WHERE source_row_id IS NOT NULL GROUP BY source_row_id),
b AS (SELECT source_row_id, {bucket_sql("key", seed, BUCKETS)} AS bucket FROM one)
SELECT source_row_id, bucket FROM b WHERE (bucket * {FACTOR} + {SHIFT}) % {BUCKETS} < {chosen_buckets(share)}"""
