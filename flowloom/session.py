"""Sessions and lineage cuts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


# HotSpot leaves methods over 8000 bytes uncompiled; wide expressions run faster split up than fused but interpreted.
HUGE_METHOD = ("spark.sql.codegen.hugeMethodLimit", "8000")


def local_session(cores: str = "*", **conf: str) -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("flowloom")
    defaults = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    }
    for k, v in (defaults | conf).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Only a local session without one gets a folder of its own."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    at = tempfile.mkdtemp(prefix="flowloom-")
    atexit.register(shutil.rmtree, at, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", at)
    return at


def materialize(df: DataFrame, name: str = "step", by: str | None = None) -> DataFrame:
    """df written once to the shared folder and read back: a lineage cut that outlives executors.

    A written table is computed once, while checkpoint() computes its last stage twice; it also
    gives the planner its true size. Drop it with `discard` when the next step is written, or let a `scope` drop it.
    by: a column whose values get folders of their own, so that a filter on it reads only those.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/flowloom-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path, partitionBy=by)
    out = spark.read.schema(df.schema).parquet(path)
    out._flowloom_path = path
    for paths in _SCOPES[-1:]:
        paths.append(path)
    return out


_SCOPES: list[list[str]] = []  # the tables of every open scope of the driver, the innermost last


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables that are materialized inside are deleted at its end, also after an error. Write or collect the result before that."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(df: DataFrame) -> None:
    """Delete the table behind a materialized frame that nothing reads any more."""
    path = getattr(df, "_flowloom_path", None)
    if path:
        _delete(df.sparkSession, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder. A session that leaves the limit of generated methods alone gets the one that HotSpot compiles."""
    key, limit = HUGE_METHOD
    if spark.conf.get(key) == "65535":  # Spark's own value
        spark.conf.set(key, limit)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
