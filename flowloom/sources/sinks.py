"""Writers: partitioned Parquet, quarantine, manifests, CSV tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

ROW_GROUP = 100_000 * 400  # bytes of a row group of about 100 000 flows


def partitioned(df: DataFrame, path: str, by: str, overwrite: bool = False) -> None:
    """Parquet in a folder per value of `by`, zstd, committed at once; an existing folder raises unless it may be overwritten.

    Rows are not shuffled by `by`: a value that holds most rows keeps the input's partitions, so its files are written in parallel.
    """
    w = df.write.mode("overwrite" if overwrite else "errorifexists").option("compression", "zstd").option("parquet.block.size", ROW_GROUP)
    w.partitionBy(by).parquet(path)


def quarantine(rejected: DataFrame, path: str) -> int:
    """Writes rejected rows with their reasons, only if there are any; their number."""
    n = rejected.count()
    if n:
        rejected.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    return n


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def manifest(spark: SparkSession, value: dict, path: str) -> None:
    """A JSON document without NaN, written aside and then renamed, so that a reader never sees half of it."""
    text = json.dumps(value, allow_nan=False, ensure_ascii=False, indent=2, sort_keys=True)
    fs, final = _fs(spark, path)
    _, part = _fs(spark, f"{path}.partial")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(final):
        fs.delete(final, False)
    if not fs.rename(part, final):
        raise OSError(f"could not publish {path}")


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def csv_table(df: DataFrame, path: str) -> None:
    """A result table as one CSV file with header; for results, not for flows."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
