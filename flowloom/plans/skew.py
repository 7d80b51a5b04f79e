"""Problem 4: per-key results over destinations, destination ports and classes, a few of which hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.functions import canon
from flowloom.operators.skew import heavy_keys, key_profile
from flowloom.session import table

HEAVY_PERCENT = 2


def _profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    flows = table(spark, sf_dir, "full_splits")
    keys = {"IPV4_DST_ADDR": canon.host_number("IPV4_DST_ADDR"), "L4_DST_PORT": F.col("L4_DST_PORT"), "Attack": canon.word_key("Attack")}
    return key_profile(flows, keys, F.col("source_row_id"), F.col("Label"), F.col("IN_BYTES"))


def _named(profile: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses in dotted form, and classes as sampling_targets (a fixed table) spells them, other classes by their key."""
    names = table(spark, sf_dir, "sampling_targets").where("category_field = 'Attack'").groupBy(canon.word_key("category").alias("_key")).agg(F.min("category").alias("_name"))
    p = profile.join(F.broadcast(names), (F.col("key_field") == "Attack") & (F.col("key_value") == F.col("_key")), "left")
    shown = F.when(F.col("key_field") == "IPV4_DST_ADDR", canon.dotted(F.col("key_value").try_cast("bigint"))).otherwise(F.coalesce("_name", "key_value"))
    return p.withColumn("key_value", shown).drop("_key", "_name")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of a destination, port or class that hold at least 2 % of all rows; missing is no value."""
    total = table(spark, sf_dir, "full_splits").count()
    return _named(heavy_keys(_profile(spark, sf_dir), total, HEAVY_PERCENT), spark, sf_dir).select("key_field", "key_value")


def p4_key_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per key: rows, bytes in, first and last row, label changes along the row ids."""
    p = _named(_profile(spark, sf_dir), spark, sf_dir)
    return p.select("key_field", "key_value", "n", F.col("size").cast("bigint").alias("bytes_in"), "first_id", "last_id", "label_changes")


def _sql() -> tuple[str, str]:
    host, word = canon.host_number_sql("IPV4_DST_ADDR"), canon.word_key_sql("Attack")
    name = f"(SELECT min(category) FROM sampling_targets WHERE category_field = 'Attack' AND {canon.word_key_sql('category')} = v)"
    rows = f"""
WITH flow AS (SELECT source_row_id AS id, Label AS label, coalesce(IN_BYTES, 0) AS size, {host} AS host, L4_DST_PORT AS port, {word} AS word FROM full_splits),
keyed AS (
  SELECT 'IPV4_DST_ADDR' AS key_field, CASE WHEN host IS NOT NULL THEN {canon.dotted_sql('host')} END AS v, id, label, size FROM flow
  UNION ALL SELECT 'L4_DST_PORT', CAST(port AS VARCHAR), id, label, size FROM flow
  UNION ALL SELECT 'Attack', word, id, label, size FROM flow)"""
    shown = f"CASE WHEN key_field = 'Attack' THEN coalesce({name}, v) ELSE v END AS key_value"
    found = f"""{rows},
n AS (SELECT key_field, v, count(*) AS n FROM keyed WHERE v IS NOT NULL GROUP BY ALL)
SELECT key_field, {shown} FROM n WHERE n * 100 >= {HEAVY_PERCENT} * (SELECT count(*) FROM full_splits)"""
    profile = f"""{rows},
seen AS (SELECT *, lag(id) OVER w IS NOT NULL AND coalesce(label, -1) <> coalesce(lag(label) OVER w, -1) AS changed FROM keyed WINDOW w AS (PARTITION BY key_field, v ORDER BY id)),
s AS (SELECT key_field, v, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes_in, min(id) AS first_id, max(id) AS last_id, CAST(count(*) FILTER (WHERE changed) AS BIGINT) AS label_changes FROM seen GROUP BY ALL)
SELECT key_field, {shown}, n, bytes_in, first_id, last_id, label_changes FROM s"""
    return found, profile


QUERIES = {"p4_found": p4_found, "p4_key_profile": p4_key_profile}
SQL = dict(zip(QUERIES, _sql(), strict=True))
