"""Audits of flow tables: counts, duplicates, conflicts, leaks, gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def n_rows() -> Column:
    """The number of rows of a group."""
    return F.count(F.lit(1))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0, rounded to nine digits."""
    return F.when(b != 0, F.round(a / b, 9)).otherwise(0.0)


def audit_row(df: DataFrame, label: str = "Label", attack: str = "Attack") -> DataFrame:
    """One row of counts and extremes from one pass."""
    return df.agg(
        n_rows().alias("rows"), F.countDistinct("source_row_id").alias("ids"), F.countDistinct("flow_group_id").alias("groups"),
        F.min("L4_SRC_PORT").alias("min_src_port"), F.max("L4_SRC_PORT").alias("max_src_port"), F.min("L4_DST_PORT").alias("min_dst_port"), F.max("L4_DST_PORT").alias("max_dst_port"),
        F.count_if(F.col(label) == 0).alias("benign"), F.count_if(F.col(label) == 1).alias("attacks"), F.count_if(F.col(attack).isNull()).alias("no_class"),
        F.count_if(F.col(label) != (F.col(attack) != "Benign").cast("bigint")).alias("contradictions"),
    )


def group_states(df: DataFrame, key: str, attack: str) -> DataFrame:
    """Per group: rows, and whether its classes differ."""
    return df.groupBy(key).agg(n_rows().alias("n"), F.min(attack).alias("lo"), F.max(attack).alias("hi"))


def excess_duplicates(df: DataFrame, key: str) -> DataFrame:
    """Groups that repeat and the rows beyond the first of each."""
    return df.groupBy(key).agg(n_rows().alias("n")).where("n > 1").agg(n_rows().alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("excess"))


def label_conflicts(df: DataFrame, splits: DataFrame, key: str, attack: str) -> DataFrame:
    """(split, groups, rows) of groups with more than one class, 0 for a split without any; `splits` lists all of them."""
    bad = df.groupBy("split", key).agg(n_rows().alias("n"), F.min(attack).alias("lo"), F.max(attack).alias("hi")).where("lo <> hi")
    per = bad.groupBy("split").agg(n_rows().alias("groups"), F.sum("n").alias("rows"))
    return splits.join(per, "split", "left").fillna(0, ["groups", "rows"])


def shared_keys(df: DataFrame, key: str, by: str = "split") -> DataFrame:
    """Keys that stand in more than one split, with the splits they stand in."""
    return df.where(F.col(key).isNotNull() & F.col(by).isNotNull()).groupBy(key).agg(F.countDistinct(by).alias("splits")).where("splits > 1")


def endpoint_overlap(train: DataFrame, held: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct endpoints of held-out rows, and how many of them train has too."""
    stack = lambda d: reduce(DataFrame.union, [d.select(F.col(c).alias("ip")) for c in columns]).where("ip IS NOT NULL").distinct()
    both = stack(held).join(stack(train).withColumn("known", F.lit(1)), "ip", "left")
    got = both.agg(n_rows().alias("held_ips"), F.count("known").alias("known_ips"))
    return got.withColumn("overlap", ratio(F.col("known_ips"), F.col("held_ips")))


def any_differs(pairs: list[tuple[Column, Column]]) -> Column:
    """Whether any pair differs, null being equal to null only."""
    return reduce(lambda a, b: a | b, [~a.eqNullSafe(b) for a, b in pairs], F.lit(False))


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows by which two multisets differ, in either direction."""
    return a.exceptAll(b).unionByName(b.exceptAll(a))


def eligibility(df: DataFrame, splits: tuple[str, ...], attack: str, least: int) -> DataFrame:
    """(class, min_rows, eligible): a class is eligible with at least `least` rows in every split, absent counting 0."""
    each = [F.count_if(F.col("split") == s) for s in splits]
    known = df.where(F.col(attack).isNotNull()).groupBy(attack).agg(F.least(*each).alias("min_rows"))
    return known.withColumn("eligible", F.col("min_rows") >= least)


def beside(*frames: DataFrame) -> DataFrame:
    """Frames of one row each as one row: stacked and merged, so without a join."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])
