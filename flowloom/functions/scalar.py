"""Scalar formulas over columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def signed_log1p(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def z_score(x: Column, mean: Column, scale: Column) -> Column:
    """(x - mean) / scale as a float; a scale of 0 counts as 1."""
    return ((x - mean) / F.when(scale == 0, 1.0).otherwise(scale)).cast("float")


def softmax(logits: Column) -> Column:
    """An array's softmax, shifted by its maximum."""
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def argmax(p: Column) -> Column:
    """Index of an array's first maximum, from 0."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def dot(weights: Column, x: Column) -> Column:
    return F.aggregate(F.zip_with(weights, x, lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def close(a: Column, b: Column, rtol: float = 1e-9, atol: float = 1e-7) -> Column:
    """Approximate equality relative to b."""
    return F.abs(a - b) <= atol + rtol * F.abs(b)


def steps_per_pass(rows: Column, batch: Column) -> Column:
    return F.ceil(rows / batch).cast("bigint")


def step_budget(rows: Column, batch: Column, passes: Column, least: Column) -> Column:
    """Steps of a run: whole passes, but at least `least`."""
    return F.greatest(least, passes * steps_per_pass(rows, batch))


def validation_count(most: Column, first: Column, every: Column) -> Column:
    """Evaluations of a run: one after the first pass, then one per interval, and one at the end."""
    bad = (most <= 0) | (first <= 0) | (every <= 0)
    later = F.when(most > first, F.ceil((most - first) / every)).otherwise(0)
    return F.when(bad, F.raise_error("steps must be positive").cast("bigint")).otherwise((1 + later).cast("bigint"))


def reasons(conditions: dict[str, Column]) -> Column:
    """The names of the conditions that hold, as an array in their order."""
    return F.array_compact(F.array(*[F.when(c, name) for name, c in conditions.items()]))


def both(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
