"""Classification metrics over a fixed class set, and checks of stored predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.operators.audit import n_rows, ratio


def confusion(pred: DataFrame, classes: list[int], y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """(y_true, y_pred, n) over the full grid of classes, zeros kept: counts first, then laid on the grid, which is the result's own size."""
    counts = pred.groupBy(y, p).agg(n_rows().alias("n"))
    grid = pred.sparkSession.createDataFrame([(a, b) for a in classes for b in classes], f"{y} int, {p} int")
    return grid.join(counts, [y, p], "left").fillna(0, ["n"])


def per_class(pred: DataFrame, classes: list[int], y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """(class, support, tp, fp, fn, precision, recall, f1) of every class of the set; undefined ratios are 0."""
    cells = [F.struct(F.lit(c).alias("class"), F.count_if(F.col(y) == c).alias("support"), F.count_if((F.col(y) == c) & (F.col(p) == c)).alias("tp"), F.count_if((F.col(y) != c) & (F.col(p) == c)).alias("fp")) for c in classes]
    one = pred.agg(*[s.alias(f"c{i}") for i, s in enumerate(cells)])
    rows = one.select(F.explode(F.array(*[f"c{i}" for i in range(len(classes))])).alias("s")).select("s.*").withColumn("fn", F.col("support") - F.col("tp"))
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("support"))
    f1 = ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return rows.select("class", "support", "tp", "fp", "fn", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def summary(by_class: DataFrame) -> DataFrame:
    """(accuracy, macro_f1, weighted_f1, macro_precision, macro_recall) from `per_class`: macro over the fixed set, weighted by support."""
    n = F.sum("support")
    r = lambda c: F.round(c, 9)
    return by_class.agg(ratio(F.sum("tp"), n).alias("accuracy"), r(F.avg("f1")).alias("macro_f1"), ratio(F.sum(F.col("f1") * F.col("support")), n).alias("weighted_f1"), r(F.avg("precision")).alias("macro_precision"), r(F.avg("recall")).alias("macro_recall"))


def weighted_cross_entropy(p_true: Column, weight: Column) -> Column:
    """Sum of weight x -ln p over the sum of weights; probabilities are kept from 0."""
    return F.sum(weight * -F.ln(F.greatest(p_true, F.lit(1e-12)))) / F.sum(weight)


def replay_error(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(matched, unmatched, max_error) of two sets of predictions by key."""
    x, y = a.alias("x"), b.alias("y")
    worst = F.greatest(*[F.abs(F.col(f"x.{c}") - F.col(f"y.{c}")) for c in columns], F.lit(0.0))
    both = x.join(y, F.col(f"x.{key}") == F.col(f"y.{key}"), "full_outer")
    one_side = F.col(f"x.{key}").isNull() | F.col(f"y.{key}").isNull()
    return both.agg(F.count_if(~one_side).alias("matched"), F.count_if(one_side).alias("unmatched"), F.max(F.when(~one_side, worst)).alias("max_error"))
