"""Readers: typed CSV, Parquet directories, run tables, JSON documents, file checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.schema import SPLITS, raw_schema, require_columns

CORRUPT = "_corrupt_record"


def flows_csv(spark: SparkSession, path: str) -> DataFrame:
    """Raw flows from CSV with header, explicit types, empty text as null; a line that does not fit keeps its text in `_corrupt_record`."""
    schema = T.StructType([*raw_schema().fields, T.StructField(CORRUPT, T.StringType())])
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).option("enforceSchema", False).csv(path)


def text_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV whose columns are all text, for inventories."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def split_parquet(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """A table partitioned by split, or one of its splits, of which only that folder is read."""
    df = spark.read.parquet(path)
    return df if split is None else df.where(F.col("split") == split)


def scoped_flows(spark: SparkSession, root: str, dataset: str, scope: str = "full", needed: tuple[str, ...] = ()) -> DataFrame:
    """The pilot sample or the full partitions of one Dataset, all splits present; a missing split or a foreign row raises."""
    df = require_columns(spark.read.parquet(f"{root}/{scope}/{dataset}"), ["split", "Dataset", *needed])
    seen = {r["split"]: r["foreign"] for r in df.groupBy("split").agg(F.count_if(~F.col("Dataset").eqNullSafe(dataset)).alias("foreign")).collect()}
    if missing := [s for s in SPLITS if s not in seen]:
        raise ValueError(f"missing splits: {', '.join(missing)}")
    if any(seen.values()):
        raise ValueError(f"rows of another dataset than {dataset}")
    return df


def tagged_sources(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Several Parquet sources as one, each row with the name of its source."""
    return reduce(DataFrame.unionByName, [spark.read.parquet(p).withColumn("source", F.lit(n)) for n, p in paths.items()])


def run_table(spark: SparkSession, path: str, keys: tuple[str, ...] = ("dataset", "task", "model", "seed")) -> DataFrame:
    """A run table from CSV; missing key columns, null keys and repeated keys raise."""
    df = require_columns(spark.read.option("header", True).option("inferSchema", True).csv(path), keys)
    bad = df.groupBy(*keys).count().where(reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys], F.col("count") > 1)).limit(5).collect()
    if bad:
        raise ValueError(f"repeated or missing keys: {[tuple(r)[:-1] for r in bad]}")
    return df


def json_documents(spark: SparkSession, glob: str) -> DataFrame:
    """Many JSON documents, one row each, with the file they come from."""
    return spark.read.option("multiLine", True).json(glob).withColumn("file", F.input_file_name())


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files, read where they lie."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def parquet_ready(spark: SparkSession, path: str, rows: int, sha256: str | None = None) -> tuple[bool, str | None]:
    """Whether a single Parquet file has its magic bytes, that many rows and that digest; else why not."""
    try:
        f = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, 4).alias("head"), F.expr("substring(content, -4, 4)").alias("tail"), F.sha2("content", 256).alias("sha256")).first()
    except Exception as e:  # noqa: BLE001
        return False, f"unreadable: {type(e).__name__}"
    if f is None or bytes(f["head"]) != b"PAR1" or bytes(f["tail"]) != b"PAR1":
        return False, "not a Parquet file"
    if sha256 and f["sha256"] != sha256:
        return False, "digest differs"
    n = spark.read.parquet(path).count()
    return (True, None) if n == rows else (False, f"{n} rows, not {rows}")
