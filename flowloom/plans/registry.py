"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from flowloom.functions import canon
from flowloom.session import table


class Tables:
    """Tables of a data folder as attributes; `flow` is full_splits with canonical split names."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @property
    def flow(self) -> DataFrame:
        return self.full_splits.withColumn("split", canon.split_name("split"))


# The SQL twin of Tables.flow, to stand before a query.
FLOW = f"flow AS (SELECT * EXCLUDE (split), {canon.split_name_sql('split')} AS split FROM full_splits)"


class Registry:
    """Queries by name; a query without SQL is checked by tests instead."""

    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None):
        def add(f: Callable[[Tables], DataFrame]):
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return f(Tables(spark, sf_dir))

            run.__name__, run.__doc__ = name, f.__doc__
            self.queries[name] = run
            if sql:
                self.sql[name] = sql.replace("WITH flow ", f"WITH {FLOW} ", 1) if "WITH flow " in sql else sql
            return f

        return add
