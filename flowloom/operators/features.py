"""Train-only feature statistics, standardisation, class codes and weights."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions.scalar import signed_log1p, z_score
from flowloom.operators.validation import nonfinite
from flowloom.schema import require_columns

# Fixed value: columns whose largest magnitude in train exceeds it are put on a signed log scale.
LOG_ABOVE = 1e20


@dataclass
class Preprocessor:
    """Statistics of the training rows, and what they do to any rows. A mean or scale stands at the place of its feature."""

    features: list[str]
    classes: list[str]
    mean: list[float]
    scale: list[float]
    task: str
    log_features: list[str]

    @classmethod
    def fit(cls, train: DataFrame, features: list[str], task: str) -> Preprocessor:
        """Two passes: magnitudes choose the log columns, then mean and population deviation of the transformed columns. Nulls and nonfinite values raise."""
        require_columns(train, [*features, "Label", "Attack"])
        first = train.agg(*[F.max(F.abs(F.col(f).cast("double"))).alias(f) for f in features], F.sum(sum((nonfinite(f).cast("int") for f in features), F.lit(0))).alias("_bad")).first()
        if first is None or first["_bad"] is None or first["_bad"] > 0:
            raise ValueError("train has no rows, or values that are not finite")
        logs = [f for f in features if first[f] > LOG_ABOVE]
        cols = {f: stabilized(f, logs) for f in features}
        stats = train.agg(*[F.avg(c).alias(f"m_{f}") for f, c in cols.items()], *[F.stddev_pop(c).alias(f"s_{f}") for f, c in cols.items()]).first()
        classes = ["Benign", "Attack"] if task == "binary" else sorted(r[0] for r in train.select("Attack").distinct().collect())
        return cls(list(features), classes, [stats[f"m_{f}"] for f in features], [stats[f"s_{f}"] or 1.0 for f in features], task, logs)

    def transform(self, rows: DataFrame, vector: str = "x") -> DataFrame:
        """rows with `vector`, the standardised features as floats; a value that is not finite raises when it is computed."""
        cells = []
        for f, m, s in zip(self.features, self.mean, self.scale, strict=True):
            z = z_score(stabilized(f, self.log_features), F.lit(m), F.lit(s))
            cells.append(F.when(nonfinite(f), F.raise_error(f"{f} is not finite").cast("float")).otherwise(z))
        return rows.withColumn(vector, F.array(*cells))

    def labels(self, rows: DataFrame, name: str = "y") -> DataFrame:
        """rows with `name`, the class code; a class that train did not have raises when it is computed."""
        if self.task == "binary":
            code, bad = F.col("Label").cast("int"), ~F.coalesce(F.col("Label").isin(0, 1), F.lit(False))
        else:
            code = F.array_position(F.array(*[F.lit(c) for c in self.classes]), F.col("Attack")).cast("int") - 1
            bad = F.coalesce(code < 0, F.lit(True))
        return rows.withColumn(name, F.when(bad, F.raise_error("unknown class").cast("int")).otherwise(code))

    def to_json(self) -> str:
        return json.dumps(asdict(self), allow_nan=False)

    @classmethod
    def from_json(cls, text: str) -> Preprocessor:
        p = cls(**json.loads(text))
        if not len(p.features) == len(p.mean) == len(p.scale):
            raise ValueError("features, mean and scale differ in length")
        return p

    def equivalent(self, other: Preprocessor, rtol: float = 1e-9, atol: float = 1e-7) -> bool:
        """Equal names and order, statistics equal within tolerance."""
        same = (self.features, self.classes, self.task, self.log_features) == (other.features, other.classes, other.task, other.log_features)
        near = lambda a, b: all(abs(x - y) <= atol + rtol * abs(y) for x, y in zip(a, b, strict=True))
        return same and near(self.mean, other.mean) and near(self.scale, other.scale)


def stabilized(feature: str, logs: list[str]) -> Column:
    x = F.col(feature).cast("double")
    return signed_log1p(x) if feature in logs else x


def feature_stats(train: DataFrame, features: list[str], logs: list[str]) -> DataFrame:
    """(feature, mean, scale), one pass over all columns."""
    one = train.agg(*[F.struct(F.avg(stabilized(f, logs)).alias("mean"), F.stddev_pop(stabilized(f, logs)).alias("scale")).alias(f) for f in features])
    return one.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"{f}.mean"), F.col(f"{f}.scale")) for f in features])).alias("s")).select("s.*")


def finite(feature: str) -> Column:
    """The value if it is finite, else null."""
    return F.when(~nonfinite(feature), F.col(feature))


def train_stats(train: DataFrame, features: list[str]) -> DataFrame:
    """(feature, logged, n, mean, scale) of the finite values, which n counts: raw maxima choose the log columns, then statistics of the transformed ones.

    A scale of 0 counts as 1; a column without a finite value has null for both.
    """
    known = train.select(*[finite(f).alias(f) for f in features])
    top = known.agg(*[F.max(F.abs(F.col(f).cast("double"))).alias(f) for f in features]).first()
    logs = [f for f in features if (top[f] or 0.0) > LOG_ABOVE]
    one = known.agg(*[F.struct(F.count(f).alias("n"), F.avg(stabilized(f, logs)).alias("mean"), F.stddev_pop(stabilized(f, logs)).alias("scale")).alias(f) for f in features])
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(f in logs).alias("logged"), F.col(f"{f}.n"), F.col(f"{f}.mean"), F.when(F.col(f"{f}.scale") == 0, 1.0).otherwise(F.col(f"{f}.scale")).alias("scale")) for f in features])
    return one.select(F.explode(rows).alias("s")).select("s.*")


def class_weights(train: DataFrame, label: str) -> DataFrame:
    """(class, n, weight) with weight = rows / (classes x n); counts first, so the rest runs on the classes."""
    n = train.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("classes")).first()
    return n.withColumn("weight", F.lit(total["rows"] or 0) / (F.lit(total["classes"] or 1) * F.col("n")))
