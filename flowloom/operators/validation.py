"""Row validation: rejection reasons, and the split into clean and rejected rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.schema import DATASETS, DST_IP, DST_PORT, NUMERIC_COLUMNS, RAW_COLUMNS, SRC_IP, SRC_PORT, require_columns

# The order in which reasons are joined.
REASONS = ("missing", "nonfinite", "port_invalid", "ip_invalid", "dataset_invalid", "attack_empty", "label_invalid")
_IPV4 = r"^((25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])$"


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def nonfinite(c: str | Column) -> Column:
    """Null, NaN or infinite."""
    c = (F.col(c) if isinstance(c, str) else c).cast("double")
    return c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))


def strict_ipv4(c: str) -> Column:
    """Four decimal octets without leading zeros; null and anything else is false."""
    return F.coalesce(F.col(c).rlike(_IPV4), F.lit(False))


def port_invalid(c: str) -> Column:
    """Null, fractional, or outside 0..65535."""
    v = F.col(c).cast("double")
    return F.coalesce(~v.between(0, 65535) | (v % 1 != 0), F.lit(True))


def reason_columns(raw: DataFrame) -> dict[str, Column]:
    """A condition for each reason, never null. Whole-number columns can only be null, so only the others are tested for NaN and infinity."""
    attack = F.coalesce(F.col("Attack"), F.lit(""))
    whole = {c for c, t in raw.dtypes if t in ("bigint", "int", "smallint", "tinyint")}
    return {
        "missing": any_of([F.col(c).isNull() for c in RAW_COLUMNS]),
        "nonfinite": any_of([F.col(c).isNull() if c in whole else nonfinite(c) for c in NUMERIC_COLUMNS]),
        "port_invalid": port_invalid(SRC_PORT) | port_invalid(DST_PORT),
        "ip_invalid": ~strict_ipv4(SRC_IP) | ~strict_ipv4(DST_IP),
        "dataset_invalid": ~F.coalesce(F.col("Dataset").isin(*DATASETS), F.lit(False)),
        "attack_empty": F.regexp_replace(attack, r"\s", "") == "",
        "label_invalid": F.coalesce(~F.col("Label").isin(0, 1) | (F.col("Label") != (attack != "Benign").cast("bigint")), F.lit(True)),
    }


def tagged(raw: DataFrame) -> DataFrame:
    """raw with `rejection_reasons`, the reasons joined by | in their fixed order; empty for a clean row."""
    require_columns(raw, RAW_COLUMNS)
    conditions = reason_columns(raw)
    return raw.withColumn("rejection_reasons", F.concat_ws("|", *[F.when(conditions[r], r) for r in REASONS]))


def clean_and_rejected(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clean rows without the tag, and rejected rows with it. The reasons are put together for rejected rows only."""
    bad = any_of(list(reason_columns(raw).values()))
    return raw.where(~bad), tagged(raw.where(bad))


def reason_counts(t: DataFrame) -> DataFrame:
    """(reason, n): rows by reason, a row counting for each of its reasons; reasons that never occur have 0."""
    total = t.agg(*[F.count_if(F.array_contains(F.split("rejection_reasons", r"\|"), r)).alias(r) for r in REASONS])
    return total.select(F.explode(F.array(*[F.struct(F.lit(r).alias("reason"), F.col(r).alias("n")) for r in REASONS])).alias("x")).select("x.*")


def endpoint_port(c: str) -> Column:
    """The port of an ip:port string as a double; null if it is no number."""
    return F.element_at(F.split(F.trim(c), ":"), -1).try_cast("double")


def normalized(df: DataFrame, schema) -> DataFrame:
    """Validated rows cast to their final types, strings trimmed."""
    return df.select(*[(F.trim(f.name) if f.dataType.typeName() == "string" else F.col(f.name).cast(f.dataType)).alias(f.name) for f in schema.fields])
