"""Deterministic splits and samples by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.functions.hashing import bucket, digest
from flowloom.operators.skew import ordinals

SPLIT_SEED, PILOT_SEED, HOLDOUT_SEED = 20260920, 20260921, 20260927
PILOT_CAPS = {"train": 20_000, "val": 5_000, "test": 10_000}


def split_of_bucket(b: Column) -> Column:
    """Of ten buckets, seven are train, one val, two test."""
    return F.when(b < 7, "train").when(b == 7, "val").otherwise("test")


def group_split(key: Column, seed: int = SPLIT_SEED) -> Column:
    """The split of a group key; a whole group gets one split."""
    return split_of_bucket(bucket(key, seed, 10))


def top_per_group(df: DataFrame, groups: list[str], order: list[Column], cap: Column | int) -> DataFrame:
    """The first `cap` rows of each group; Spark limits each partition's rows of a group before the shuffle if cap is a number."""
    w = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= cap).drop("_rank")


def pilot_sample(flow: DataFrame, caps: dict[str, int], seed: int = PILOT_SEED) -> DataFrame:
    """Per (split, Attack) the rows with the smallest hashes, at most the split's cap; a smaller class is kept whole."""
    order = [digest(F.concat_ws("|", "flow_group_id", F.col("source_row_id").cast("string")), seed), F.col("source_row_id")]
    parts = [top_per_group(flow.where(F.col("split") == s), ["split", "Attack"], order, cap) for s, cap in caps.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def endpoint_holdout(flow: DataFrame, src: str, dst: str, seed: int = HOLDOUT_SEED) -> DataFrame:
    """Rows whose two endpoints hash to the same split, which becomes their split."""
    own = group_split(F.col(src), seed)
    return flow.withColumn("split", own).where(F.col("split") == group_split(F.col(dst), seed))


def stratified_splits(df: DataFrame, label: str, order: list[str], parts: list[tuple[str, float]]) -> DataFrame:
    """df with `part`: cumulative shares of each class by the row's place in its class, in the order given.

    Places come from a range partition, so that a class with most rows is not sorted in one task.
    """
    placed = ordinals(df, [label], order, "_place")
    sizes = df.groupBy(F.col(label).alias("_label")).agg(F.count(F.lit(1)).alias("_n"))
    placed = placed.join(sizes, F.col(label).eqNullSafe(F.col("_label")))
    at, part, upto = (F.col("_place") + 0.5) / F.col("_n"), F.lit(None).cast("string"), 1.0
    for name, share in reversed(parts):
        part = F.when(at <= upto + 1e-12, name).otherwise(part)
        upto -= share
    return placed.select(*df.columns, part.alias("part"))


def evenly_spaced(df: DataFrame, index: str, n: int, k: int | None) -> DataFrame:
    """Rows at trunc(linspace(0, n - 1, k)) of a 0-based index column; all rows if k is unset or at least n."""
    if k is None or k >= n:
        return df
    if k <= 1:
        return df.where(F.col(index) == 0) if k == 1 else df.limit(0)
    step = F.lit(float(n - 1)) / (k - 1)
    near = F.floor(F.col(index) / step)
    hit = lambda i: (i >= 0) & (i < k) & (F.floor(F.when(i == k - 1, F.lit(float(n - 1))).otherwise(i * step)) == F.col(index))
    return df.where(hit(near) | hit(near + 1))
