"""Analysis of run tables: pivots, paired contrasts, summaries, choices, gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.operators.audit import n_rows

CELL = ["dataset", "task", "seed"]
# The published pairs of models.
MODEL_PAIRS = (("sage", "edge_mlp"), ("sage_edge", "edge_mlp"), ("sage_edge", "sage"))


def one_per_key(runs: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key; which of several equal keys stays is decided by the remaining columns in order."""
    rest = [F.col(c) for c in runs.columns if c not in keys]
    return runs.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*rest))).where("_r = 1").drop("_r")


def wide(runs: DataFrame, models: list[str], metric: str) -> DataFrame:
    """Cells by model; the models are given, so no pass to find them."""
    return runs.groupBy(*CELL).pivot("model", models).agg(F.first(metric))


def paired_deltas(runs: DataFrame, pairs, metric: str) -> DataFrame:
    """(dataset, task, seed, contrast, delta) of each pair of models in each cell, null where one is missing."""
    w = wide(runs, sorted({m for p in pairs for m in p}), metric)
    return w.select(*CELL, F.explode(F.array(*[F.struct(F.lit(f"{a}-{b}").alias("contrast"), F.round(F.col(a) - F.col(b), 9).alias("delta")) for a, b in pairs])).alias("d")).select(*CELL, "d.contrast", "d.delta")


def condition_deltas(sets: dict[str, DataFrame], base: str, keys: list[str], metric: str) -> DataFrame:
    """(keys, contrast, delta): the base's metric less each other set's, aligned by key."""
    first = sets[base].select(*keys, F.col(metric).alias("_base"))
    parts = [first.join(d.select(*keys, F.col(metric).alias("_other")), keys).select(*keys, F.lit(f"{base}-{n}").alias("contrast"), F.round(F.col("_base") - F.col("_other"), 9).alias("delta")) for n, d in sets.items() if n != base]
    return reduce(DataFrame.unionByName, parts)


def unmatched(a: DataFrame, b: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """Cells that only one side has, or whose delta is not a number: what must be empty before deltas are reported."""
    x = a.select(*keys, F.col(metric).alias("_a"), F.lit(1).alias("_in_a"))
    y = b.select(*keys, F.col(metric).alias("_b"), F.lit(1).alias("_in_b"))
    j = x.join(y, keys, "full_outer")
    return j.where(F.col("_in_a").isNull() | F.col("_in_b").isNull() | (F.col("_a") - F.col("_b")).isNull()).select(*keys)


def summaries(runs: DataFrame, keys: list[str], metrics: list[str], digits: int = 9) -> DataFrame:
    """Mean and sample deviation of several metrics by group; the deviation of one value is null."""
    return runs.groupBy(*keys).agg(n_rows().alias("n"), *[f(m).alias(f"{m}_{s}") for m in metrics for s, f in (("mean", lambda c: F.round(F.avg(c), digits)), ("std", lambda c: F.round(F.stddev_samp(c), digits)))])


def effect_summary(deltas: DataFrame, keys: list[str]) -> DataFrame:
    """n, mean, std, median, extremes, and the signs of the deltas."""
    d = F.col("delta")
    r = lambda c: F.round(c, 9)
    return deltas.groupBy(*keys).agg(F.count("delta").alias("n"), r(F.avg(d)).alias("mean"), r(F.stddev_samp(d)).alias("std"), r(F.median(d)).alias("median"), F.min(d).alias("least"), F.max(d).alias("most"), F.count_if(d > 0).alias("positive"), F.count_if(d < 0).alias("negative"), F.count_if(d == 0).alias("zero"))


def best_rows(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in the order given."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def early_stop(history: DataFrame, keys: list[str], step: str, score: str, patience: int) -> DataFrame:
    """(keys, best_step, best_score, stopped_at): the first strict maximum before the score has failed `patience` times to exceed it."""
    w = Window.partitionBy(*keys).orderBy(step)
    before = F.max(score).over(w.rowsBetween(Window.unboundedPreceding, -1))
    h = history.withColumn("_new", F.coalesce(F.col(score) > before, F.col(score).isNotNull()).cast("int")).withColumn("_i", F.row_number().over(w))
    h = h.withColumn("_last", F.max(F.when(F.col("_new") == 1, F.col("_i"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    h = h.withColumn("_stop", F.min(F.when(F.col("_i") - F.col("_last") >= patience, F.col("_i"))).over(Window.partitionBy(*keys)))
    kept = h.where(F.col("_stop").isNull() | (F.col("_i") <= F.col("_stop")))
    best = F.struct(F.col(score).alias("v"), (-F.col("_i")).alias("i"), F.col(step).alias("s"))
    return kept.groupBy(*keys).agg(F.max(F.when(F.col(score).isNotNull(), best)).alias("b"), F.max(step).alias("stopped_at")).select(*keys, F.col("b.s").alias("best_step"), F.col("b.v").alias("best_score"), "stopped_at")


def tolerant_choice(candidates: DataFrame, keys: list[str], score: str, order: list[str], within: float = 0.005) -> DataFrame:
    """Per group, of the candidates within `within` of the best score the first by `order`."""
    top = F.max(score).over(Window.partitionBy(*keys))
    near = candidates.withColumn("_top", top).where(F.col(score) >= F.col("_top") - within).drop("_top")
    return best_rows(near, keys, [F.col(c) for c in order])


def timing_windows(batches: DataFrame, keys: list[str], index: str, seconds: str, warmup: int = 50, window: int = 50) -> DataFrame:
    """(keys, windows, median, p90, mad) of the means of full windows of consecutive rows after a warm-up; index counts from 0. A group without a full window is left out."""
    w = batches.where(F.col(index) >= warmup).withColumn("_w", F.floor((F.col(index) - warmup) / window))
    means = w.groupBy(*keys, "_w").agg(n_rows().alias("_n"), F.avg(seconds).alias("_m")).where(F.col("_n") == window)
    mid = means.groupBy(*keys).agg(n_rows().alias("windows"), F.median("_m").alias("median"), F.percentile("_m", 0.9).alias("p90"))
    spread = means.join(mid, keys).groupBy(*keys).agg(F.median(F.abs(F.col("_m") - F.col("median"))).alias("mad"))
    r = lambda c: F.round(c, 9).alias(c)
    return mid.join(spread, keys).select(*keys, "windows", r("median"), r("p90"), r("mad"))


def rare_classes(by_class: DataFrame, keys: list[str], below: int = 1000) -> DataFrame:
    """Support, mean and sample deviation of F1 of classes with little support, which is constant over the seeds."""
    return by_class.where(F.col("support") < below).groupBy(*keys).agg(F.max("support").alias("support"), F.round(F.avg("f1"), 9).alias("f1_mean"), F.round(F.stddev_samp("f1"), 9).alias("f1_std"))


def missing_cells(axes: dict[str, list], done: DataFrame) -> DataFrame:
    """The cells of a run matrix that are not done: the axes' product, built on the driver, against the completed keys."""
    from itertools import product

    names = list(axes)
    kinds = {c: t for c, t in done.dtypes}
    grid = done.sparkSession.createDataFrame(list(product(*axes.values())), ", ".join(f"{n} {kinds[n]}" for n in names))
    return grid.join(done.select(*names).distinct(), names, "left_anti")
