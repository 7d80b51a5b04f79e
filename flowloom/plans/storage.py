"""Sources and sinks as queries: each writes to the shared folder, reads back and reports."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom import schema
from flowloom.operators import validation as V
from flowloom.operators.audit import n_rows
from flowloom.plans.registry import Registry, Tables
from flowloom.plans.validation import RAW, TAG, raw
from flowloom.session import shared_dir
from flowloom.sources import readers, sinks

Q = Registry()


def folder(t: Tables, name: str) -> str:
    return f"{shared_dir(t.spark)}/flowloom-{name}-{uuid.uuid4().hex}"


@Q("s1_csv_scan", "SELECT Dataset, count(*) AS n, count(IN_BYTES) AS known, max(IN_BYTES) AS most FROM rejected_rows GROUP BY 1")
def csv_scan(t: Tables) -> DataFrame:
    """Raw records written as CSV and read with their types."""
    path = folder(t, "csv")
    t.rejected_rows.select(*schema.RAW_COLUMNS).write.option("header", True).csv(path)
    return readers.flows_csv(t.spark, path).groupBy("Dataset").agg(n_rows().alias("n"), F.count("IN_BYTES").alias("known"), F.max("IN_BYTES").alias("most"))


@Q("s2_text_scan", "SELECT Dataset, count(*) AS n, max(length(CAST(source_row_id AS VARCHAR))) AS longest FROM rejected_rows GROUP BY 1")
def text_scan(t: Tables) -> DataFrame:
    """The same file with all columns as text."""
    path = folder(t, "text")
    t.rejected_rows.select("Dataset", "source_row_id").write.option("header", True).csv(path)
    return readers.text_csv(t.spark, path).groupBy("Dataset").agg(n_rows().alias("n"), F.max(F.length("source_row_id")).cast("bigint").alias("longest"))


@Q("s3_parquet_scan", "SELECT source_row_id, Attack FROM full_splits WHERE L4_DST_PORT = 22")
def parquet_scan(t: Tables) -> DataFrame:
    """A Parquet scan with projection and pushed filter."""
    return t.full_splits.where("L4_DST_PORT = 22").select("source_row_id", "Attack")


_BY_SPLIT = "WITH flow SELECT split, count(*) AS n FROM flow WHERE split IS NOT NULL GROUP BY 1"


def _partitioned(t: Tables) -> str:
    path = folder(t, "split")
    sinks.partitioned(t.flow.where("split IS NOT NULL").select("source_row_id", "Attack", "Label", "split"), path, "split")
    return path


@Q("k1_partitioned_write", _BY_SPLIT)
def partitioned_write(t: Tables) -> DataFrame:
    """Written in a folder per split, and counted from there."""
    return readers.split_parquet(t.spark, _partitioned(t)).groupBy("split").agg(n_rows().alias("n"))


@Q("s4_hive_scan", "WITH flow SELECT split, Attack, count(*) AS n FROM flow WHERE split IS NOT NULL GROUP BY ALL")
def hive_scan(t: Tables) -> DataFrame:
    """A scan that takes the split from the folders."""
    return readers.split_parquet(t.spark, _partitioned(t)).groupBy("split", "Attack").agg(n_rows().alias("n"))


@Q("s5_pruned_scan", "WITH flow SELECT source_row_id FROM flow WHERE split = 'val'")
def pruned_scan(t: Tables) -> DataFrame:
    """A scan of one split's folder."""
    return readers.split_parquet(t.spark, _partitioned(t), "val").select("source_row_id")


@Q("s6_projected_batches", "SELECT count(*) AS n, CAST(sum(L4_DST_PORT) AS BIGINT) AS ports FROM full_splits")
def projected_batches(t: Tables) -> DataFrame:
    """Columns projected at the scan."""
    return t.full_splits.select("L4_DST_PORT").agg(n_rows().alias("n"), F.sum("L4_DST_PORT").alias("ports"))


@Q("s7_view", "SELECT Dataset, count(*) AS n FROM full_splits WHERE Label = 1 GROUP BY 1")
def view(t: Tables) -> DataFrame:
    """A view queried with SQL."""
    t.full_splits.createOrReplaceTempView("flowloom_data")
    return t.spark.sql("SELECT Dataset, count(*) AS n FROM flowloom_data WHERE Label = 1 GROUP BY Dataset")


@Q("s8_required_columns", "SELECT column_name AS name FROM (DESCRIBE full_splits)")
def required_columns(t: Tables) -> DataFrame:
    """Columns after the check that all required ones are there."""
    df = schema.require_columns(t.full_splits, [*schema.RAW_COLUMNS, *schema.TRACE_COLUMNS])
    return t.spark.createDataFrame([(c,) for c in df.columns], "name string")


@Q("s9_row_counts", "SELECT 'full_splits' AS name, count(*) AS n FROM full_splits UNION ALL SELECT 'late_flows', count(*) FROM late_flows UNION ALL SELECT 'rejected_rows', count(*) FROM rejected_rows")
def row_counts(t: Tables) -> DataFrame:
    """Rows of several files: scans without columns."""
    parts = [getattr(t, n).agg(F.lit(n).alias("name"), n_rows().alias("n")) for n in ("full_splits", "late_flows", "rejected_rows")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@Q("s10_scoped_load", "WITH flow SELECT split, count(*) AS n FROM flow WHERE split IS NOT NULL AND Dataset = 'NF-BoT-IoT-v2' GROUP BY 1")
def scoped_load(t: Tables) -> DataFrame:
    """One Dataset's partitions, loaded with the checks of presence and purity."""
    root, one = folder(t, "scope"), "NF-BoT-IoT-v2"
    sinks.partitioned(t.flow.where((F.col("Dataset") == one) & F.col("split").isNotNull()), f"{root}/full/{one}", "split")
    return readers.scoped_flows(t.spark, root, one).groupBy("split").agg(n_rows().alias("n"))


@Q("s11_part_files", "WITH flow SELECT count(*) AS n, count(DISTINCT source_row_id) AS ids FROM flow WHERE split = 'train'")
def part_files(t: Tables) -> DataFrame:
    """All part files of a split as one table."""
    return readers.split_parquet(t.spark, _partitioned(t), "train").agg(n_rows().alias("n"), F.countDistinct("source_row_id").alias("ids"))


@Q("s12_tagged_sources", "SELECT source, count(*) AS n FROM (SELECT 'train' AS source FROM full_splits UNION ALL SELECT 'legacy_val' FROM late_flows) GROUP BY 1")
def tagged_sources(t: Tables) -> DataFrame:
    """Two sources with their names."""
    both = readers.tagged_sources(t.spark, {"train": f"{t.sf_dir}/full_splits.parquet", "legacy_val": f"{t.sf_dir}/late_flows.parquet"})
    return both.groupBy("source").agg(n_rows().alias("n"))


@Q("s13_run_csv", "SELECT DISTINCT dataset, task, model, seed FROM runs WHERE model = 'sage'")
def run_csv(t: Tables) -> DataFrame:
    """A run table through CSV, its keys checked."""
    path = folder(t, "runs")
    sinks.csv_table(t.runs.where("model = 'sage'").dropDuplicates(["dataset", "task", "model", "seed"]), path)
    return readers.run_table(t.spark, path).select("dataset", "task", "model", F.col("seed").cast("bigint").alias("seed"))


@Q("s14_json_documents", "SELECT dataset, task, count(*) AS n FROM (SELECT DISTINCT dataset, task, model, seed FROM runs) GROUP BY ALL")
def json_documents(t: Tables) -> DataFrame:
    """Many small JSON documents, one per Dataset, exploded to rows."""
    path = folder(t, "json")
    docs = t.runs.select("dataset", "task", "model", "seed").distinct().groupBy("dataset").agg(F.collect_list(F.struct("task", "model", "seed")).alias("history"))
    docs.repartition(4, "dataset").write.json(path)
    got = t.spark.read.json(path).select("dataset", F.explode("history").alias("h"))
    return got.groupBy("dataset", "h.task").agg(n_rows().alias("n"))


@Q("s16_file_ready", "SELECT count(*) AS rows, true AS ready, CAST(NULL AS VARCHAR) AS why FROM late_flows")
def file_ready(t: Tables) -> DataFrame:
    """A file's magic bytes, rows and digest."""
    path, n = f"{t.sf_dir}/late_flows.parquet", t.late_flows.count()
    digests = readers.file_digests(t.spark, path).collect()
    results = [readers.parquet_ready(t.spark, d["path"], t.spark.read.parquet(d["path"]).count(), d["sha256"]) for d in digests]  # a few files
    why = next((w for ok, w in results if not ok), None)
    return t.spark.createDataFrame([(n, why is None, why)], "rows bigint, ready boolean, why string")


@Q("k2_routed_write", "SELECT Dataset, count(*) AS n FROM full_splits GROUP BY 1")
def routed_write(t: Tables) -> DataFrame:
    """A folder per Dataset; rows without one get the default folder and come back as null."""
    path = folder(t, "routed")
    sinks.partitioned(t.full_splits.select("source_row_id", "Dataset"), path, "Dataset")
    return t.spark.read.parquet(path).groupBy("Dataset").agg(n_rows().alias("n"))


@Q("k3_quarantine_write", f"WITH {RAW} SELECT {TAG} AS rejection_reasons, count(*) AS n FROM raw WHERE {TAG} <> '' GROUP BY 1")
def quarantine_write(t: Tables) -> DataFrame:
    """Rejected rows written aside with their reasons."""
    path = folder(t, "rejected")
    sinks.quarantine(V.clean_and_rejected(raw(t))[1], path)
    return t.spark.read.parquet(path).groupBy("rejection_reasons").agg(n_rows().alias("n"))


@Q("k4_atomic_publish", "SELECT 'published' AS state, true AS final, false AS partial")
def atomic_publish(t: Tables) -> DataFrame:
    """A manifest appears at once, without its partial file."""
    path = folder(t, "publish")
    sinks.manifest(t.spark, {"state": "published"}, f"{path}/m.json")
    return t.spark.createDataFrame([(sinks.read_manifest(t.spark, f"{path}/m.json")["state"], sinks.exists(t.spark, f"{path}/m.json"), sinks.exists(t.spark, f"{path}/m.json.partial"))], "state string, final boolean, partial boolean")


@Q("k5_refuse_overwrite", "SELECT true AS refused")
def refuse_overwrite(t: Tables) -> DataFrame:
    """A second write to the same folder is refused."""
    path = _partitioned(t)
    try:
        sinks.partitioned(t.flow.select("source_row_id", "split"), path, "split")
        refused = False
    except AnalysisException:
        refused = True
    return t.spark.createDataFrame([(refused,)], "refused boolean")


@Q("k6_manifest", "SELECT Dataset, count(*) AS n FROM full_splits WHERE Dataset IS NOT NULL GROUP BY 1")
def manifest(t: Tables) -> DataFrame:
    """Counts through a JSON manifest."""
    path = f"{folder(t, 'manifest')}/m.json"
    counts = {r["Dataset"]: r["n"] for r in t.full_splits.where("Dataset IS NOT NULL").groupBy("Dataset").agg(n_rows().alias("n")).collect()}
    sinks.manifest(t.spark, {"counts": counts}, path)
    return t.spark.createDataFrame(sorted(sinks.read_manifest(t.spark, path)["counts"].items()), "Dataset string, n bigint")


@Q("k7_csv_table", "SELECT dataset, count(*) AS n FROM runs GROUP BY 1")
def csv_table(t: Tables) -> DataFrame:
    """A result table through CSV."""
    path = folder(t, "table")
    sinks.csv_table(t.runs.groupBy("dataset").agg(n_rows().alias("n")), path)
    return t.spark.read.schema("dataset string, n bigint").option("header", True).csv(path)


@Q("k9_content_digest", "SELECT true AS stable, 64 AS digits")
def content_digest(t: Tables) -> DataFrame:
    """Digests of a file, the same each time."""
    path = f"{t.sf_dir}/runs.parquet"
    a, b = (sorted(r["sha256"] for r in readers.file_digests(t.spark, path).collect()) for _ in range(2))
    return t.spark.createDataFrame([(a == b, len(a[0]))], "stable boolean, digits int")


@Q("k10_progress", "SELECT Dataset, count(*) AS n FROM full_splits WHERE Dataset IS NOT NULL GROUP BY 1")
def progress(t: Tables) -> DataFrame:
    """Progress kept after each Dataset and dropped when all are done."""
    path, done = f"{folder(t, 'progress')}/m.json", {}
    for d in schema.DATASETS:
        done[d] = t.full_splits.where(F.col("Dataset") == d).count()
        sinks.manifest(t.spark, done, path)
    rows = sorted(sinks.read_manifest(t.spark, path).items())
    sinks.remove(t.spark, path)
    return t.spark.createDataFrame(rows, "Dataset string, n bigint")


@Q("f13_json_round_trip", "SELECT dataset, task, model, seed, round(test_macro_f1, 9) AS score FROM runs")
def json_round_trip(t: Tables) -> DataFrame:
    """Nested JSON built and parsed."""
    packed = F.to_json(F.struct("dataset", "task", F.struct("model", "seed", "test_macro_f1").alias("run")))
    kind = "dataset string, task string, run struct<model string, seed bigint, test_macro_f1 double>"
    return t.runs.select(F.from_json(packed, kind).alias("j")).select("j.dataset", "j.task", "j.run.model", "j.run.seed", F.round("j.run.test_macro_f1", 9).alias("score"))


QUERIES, SQL = Q.queries, Q.sql
