"""Validation, projections and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom import schema
from flowloom.operators import validation as V
from flowloom.plans.registry import Registry, Tables

Q = Registry()

_ANY_NULL = " OR ".join(f"{c} IS NULL" for c in schema.RAW_COLUMNS)
_NONFINITE = " OR ".join(f"{c} IS NULL OR NOT isfinite({c}::DOUBLE)" for c in schema.NUMERIC_COLUMNS)
_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_IP = " OR ".join(f"NOT coalesce(regexp_full_match({c}, '({_OCTET}\\.){{3}}{_OCTET}'), false)" for c in (schema.SRC_IP, schema.DST_IP))
_PORT = " OR ".join(f"coalesce(NOT ({c} BETWEEN 0 AND 65535), true)" for c in (schema.SRC_PORT, schema.DST_PORT))
_DATASET = f"NOT coalesce(Dataset IN {schema.DATASETS}, false)"
_EMPTY = "regexp_replace(coalesce(Attack, ''), '\\s', '', 'g') = ''"
_LABEL = "coalesce(Label NOT IN (0, 1) OR Label <> (coalesce(Attack, '') <> 'Benign')::INT, true)"
CONDITIONS = dict(zip(V.REASONS, (_ANY_NULL, _NONFINITE, _PORT, _IP, _DATASET, _EMPTY, _LABEL), strict=True))
TAG = "concat_ws('|', " + ", ".join(f"CASE WHEN {c} THEN '{r}' END" for r, c in CONDITIONS.items()) + ")"
_COLUMNS = ", ".join(schema.RAW_COLUMNS)
RAW = f"raw AS (SELECT {_COLUMNS}, source_row_id FROM full_splits UNION ALL SELECT {_COLUMNS}, source_row_id FROM rejected_rows)"


def raw(t: Tables) -> DataFrame:
    """Flows and raw records that failed validation, as one input."""
    return t.full_splits.select(*schema.RAW_COLUMNS, "source_row_id").unionByName(t.rejected_rows.select(*schema.RAW_COLUMNS, "source_row_id"))


for _id, _reason in zip(("p1_missing", "p2r_nonfinite", "p3r_port_invalid", "p4r_ip_invalid", "p5r_dataset_invalid", "p6r_attack_empty", "p7r_label_invalid"), V.REASONS, strict=True):
    # p1..p8 with a plain number belong to the numbered problems; rows of the survey that share the letter get an r.
    _id = _id.replace("p1_", "p1r_")
    Q(_id, f"WITH {RAW} SELECT source_row_id FROM raw WHERE {CONDITIONS[_reason]}")(lambda t, r=_reason: raw(t).where(V.reason_columns(raw(t))[r]).select("source_row_id"))


@Q("p8r_quarantine", f"WITH {RAW} SELECT source_row_id, {TAG} AS rejection_reasons FROM raw WHERE {TAG} <> ''")
def quarantine(t: Tables) -> DataFrame:
    """Rejected rows with their reasons."""
    return V.clean_and_rejected(raw(t))[1].select("source_row_id", "rejection_reasons")


@Q("p8r_clean_counts", f"WITH {RAW} SELECT Dataset, count(*) AS n FROM raw WHERE {TAG} = '' GROUP BY ALL")
def clean_counts(t: Tables) -> DataFrame:
    """Clean rows by Dataset."""
    return V.clean_and_rejected(raw(t))[0].groupBy("Dataset").agg(F.count(F.lit(1)).alias("n"))


@Q("p9_reason_counts", f"WITH {RAW} " + " UNION ALL ".join(f"SELECT '{r}' AS reason, count(*) FILTER (WHERE {c}) AS n FROM raw" for r, c in CONDITIONS.items()))
def reason_counts(t: Tables) -> DataFrame:
    """Rows by reason, overlapping."""
    return V.reason_counts(V.tagged(raw(t)))


@Q("p9_stored_reason_counts", "SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(rejection_reasons, '|')) AS reason FROM rejected_rows) GROUP BY 1")
def stored_reason_counts(t: Tables) -> DataFrame:
    """Stored reasons of the rejected table, exploded."""
    return t.rejected_rows.select(F.explode(F.split("rejection_reasons", r"\|")).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


_SHOWN = ("IPV4_SRC_ADDR", "L4_SRC_PORT", "L7_PROTO", "IN_BYTES", "Attack", "Dataset")


@Q("p10_normalized", f"WITH {RAW} SELECT source_row_id, trim(IPV4_SRC_ADDR, ' ') AS IPV4_SRC_ADDR, L4_SRC_PORT, L7_PROTO, IN_BYTES, trim(Attack, ' ') AS Attack, trim(Dataset, ' ') AS Dataset FROM raw WHERE {TAG} = ''")
def normalized(t: Tables) -> DataFrame:
    """Clean rows in their final types."""
    clean = V.clean_and_rejected(raw(t))[0]
    ids = clean.schema["source_row_id"]
    return V.normalized(clean, schema.raw_schema().add(ids)).select("source_row_id", *_SHOWN)


_NODE = "IPV4_DST_ADDR || ':' || CAST(L4_DST_PORT AS VARCHAR)"


@Q("p11_legacy_validation", f"""
SELECT Dataset, count(*) FILTER (WHERE NOT coalesce(port BETWEEN 0 AND 65535, false)) AS bad_port, count(*) FILTER (WHERE coalesce(Label <> (coalesce(Attack, '') <> 'Benign')::INT, true)) AS bad_label
FROM (SELECT *, try_cast(string_split(trim(dst_node), ':')[-1] AS DOUBLE) AS port FROM (SELECT *, {_NODE} AS dst_node FROM rejected_rows)) GROUP BY 1""")
def legacy_validation(t: Tables) -> DataFrame:
    """Ports read from ip:port strings, and label consistency, counted by source."""
    rows = t.rejected_rows.withColumn("dst_node", F.concat("IPV4_DST_ADDR", F.lit(":"), F.col("L4_DST_PORT").cast("string")))
    port_ok = F.coalesce(V.endpoint_port("dst_node").between(0, 65535), F.lit(False))
    label_bad = F.coalesce(F.col("Label") != (F.coalesce("Attack", F.lit("")) != "Benign").cast("bigint"), F.lit(True))
    return rows.groupBy("Dataset").agg(F.count_if(~port_ok).alias("bad_port"), F.count_if(label_bad).alias("bad_label"))


@Q("p12_invalid_by_source", f"WITH raw AS (SELECT {_COLUMNS}, 'flows' AS origin FROM full_splits UNION ALL SELECT {_COLUMNS}, 'rejected' FROM rejected_rows) SELECT origin, count(*) AS n, count(*) FILTER (WHERE {TAG} <> '') AS invalid FROM raw GROUP BY 1")
def invalid_by_source(t: Tables) -> DataFrame:
    """Invalid rows by origin."""
    rows = t.full_splits.select(*schema.RAW_COLUMNS, F.lit("flows").alias("origin")).unionByName(t.rejected_rows.select(*schema.RAW_COLUMNS, F.lit("rejected").alias("origin")))
    return V.tagged(rows).groupBy("origin").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("rejection_reasons") != "").alias("invalid"))


@Q("p13_dataset_guard", "WITH flow SELECT split, count(*) FILTER (WHERE Dataset IS DISTINCT FROM 'NF-BoT-IoT-v2') AS strangers FROM flow GROUP BY 1")
def dataset_guard(t: Tables) -> DataFrame:
    """Rows that do not belong to one expected Dataset, null included, by split."""
    return t.flow.groupBy("split").agg(F.count_if(~F.col("Dataset").eqNullSafe("NF-BoT-IoT-v2")).alias("strangers"))


@Q("p14_replace_columns", "SELECT source_row_id, split, L4_DST_PORT + 1 AS L4_DST_PORT FROM (SELECT * EXCLUDE (Attack) FROM full_splits)")
def replace_columns(t: Tables) -> DataFrame:
    """All but one column, one of them replaced."""
    return t.full_splits.drop("Attack").withColumn("L4_DST_PORT", F.col("L4_DST_PORT") + 1).select("source_row_id", "split", "L4_DST_PORT")


@Q("p19_class_filter", "SELECT source_row_id FROM full_splits WHERE Attack = 'DDoS'")
def class_filter(t: Tables) -> DataFrame:
    """Rows of one class; the comparison reaches the scan."""
    return t.full_splits.where(F.col("Attack") == "DDoS").select("source_row_id")


@Q("p20_membership", "SELECT dataset, task, model, seed, test_macro_f1 FROM runs WHERE model IN ('sage', 'sage_edge') AND seed IN (11, 22)")
def membership(t: Tables) -> DataFrame:
    """Runs of some models and seeds."""
    return t.runs.where(F.col("model").isin("sage", "sage_edge") & F.col("seed").isin(11, 22)).select("dataset", "task", "model", "seed", "test_macro_f1")


@Q("p21_low_support", "WITH flow SELECT split, Attack, count(*) AS support FROM flow GROUP BY ALL HAVING count(*) < 1000")
def low_support(t: Tables) -> DataFrame:
    """Classes with fewer than 1000 rows in a split."""
    return t.flow.groupBy("split", "Attack").agg(F.count(F.lit(1)).alias("support")).where("support < 1000")


@Q("p22_finite_check", "SELECT " + ", ".join(f"count(*) FILTER (WHERE {c} IS NULL OR NOT isfinite({c}::DOUBLE)) AS {c}" for c in schema.FEATURES) + " FROM full_splits")
def finite_check(t: Tables) -> DataFrame:
    """Nonfinite values by feature, in one pass."""
    return t.full_splits.agg(*[F.count_if(V.nonfinite(c)).alias(c) for c in schema.FEATURES])


@Q("p23_unlabelled", "SELECT count(*) AS n, count(DISTINCT source_row_id) AS ids FROM (SELECT * EXCLUDE (Label, Attack) FROM full_splits)")
def unlabelled(t: Tables) -> DataFrame:
    """The flow table as it is scored: without labels."""
    return t.full_splits.drop("Label", "Attack").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source_row_id").alias("ids"))


QUERIES, SQL = Q.queries, Q.sql
