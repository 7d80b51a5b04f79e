"""The jobs from end to end: ingest, prepare, endpoint holdout, rewiring, and a runner of stages.

Each reads its source once per output, writes Parquet and a JSON report, refuses to overwrite, and raises when a gate fails.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.operators import audit, graph, splitting
from flowloom.operators import validation as V
from flowloom.operators.skew import ordinals
from flowloom.schema import DST_IP, DST_PORT, FEATURES, RAW_COLUMNS, SPLITS, SRC_IP, SRC_PORT, require_columns
from flowloom.session import materialize, scope
from flowloom.sources import readers, sinks


def fingerprint() -> Column:
    """A flow's group id: a digest of all columns but its labels."""
    cols = [c for c in RAW_COLUMNS if c not in ("Label", "Attack")]
    return F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in cols]))


def _counts(df: DataFrame, *by: str) -> list[dict]:
    return [r.asDict() for r in df.groupBy(*by).agg(audit.n_rows().alias("n")).orderBy(*by).collect()]


def _ingest(spark: SparkSession, csv: str, out: str) -> dict:
    """`ingest`, whose intermediate tables are left to the caller's scope."""
    if sinks.exists(spark, out):
        raise FileExistsError(out)
    # Spark deals pieces of files to tasks by size; within a piece rows are read in their order, so ids grow there.
    place = {"_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"), "_pos": F.monotonically_increasing_id()}
    raw = readers.flows_csv(spark, csv).withColumns(place)
    rows = ordinals(raw, [], list(place), "source_row_id").withColumn("source_row_id", F.col("source_row_id") + 1).drop(*place)
    torn = F.col(readers.CORRUPT).isNotNull()
    tags = V.tagged(rows)
    tags = materialize(tags.withColumn("rejection_reasons", F.when(torn, F.concat_ws("|", F.lit("unreadable"), F.nullif("rejection_reasons", F.lit("")))).otherwise(F.col("rejection_reasons"))), "tagged")
    clean = tags.where("rejection_reasons = ''").drop("rejection_reasons", readers.CORRUPT).withColumn("flow_group_id", fingerprint())
    sinks.partitioned(clean, f"{out}/clean", "Dataset")
    rejected = sinks.quarantine(tags.where("rejection_reasons <> ''"), f"{out}/rejected")
    reasons = {r["reason"]: r["n"] for r in V.reason_counts(tags).collect()}
    report = {"rows": tags.count(), "rejected": rejected, "reasons": reasons, "classes": _counts(clean, "Dataset", "Attack")}
    sinks.manifest(spark, report, f"{out}/report.json")
    return report


def ingest(spark: SparkSession, csv: str, out: str) -> dict:
    """CSV to typed Parquet by Dataset (out/clean), rejected rows with reasons (out/rejected), and out/report.json.

    Rows are numbered from 1 in input order, files by name, before anything is dropped, so that a rejected row keeps its number.
    """
    with scope(spark):
        return _ingest(spark, csv, out)


def check_split(flow: DataFrame, source_rows: int) -> None:
    """Raises unless there are three splits, no row is lost, every class of train is in each split, and no group is in two."""
    got = flow.agg(F.countDistinct("split").alias("s"), audit.n_rows().alias("n")).first()
    if got["s"] != len(SPLITS):
        raise ValueError(f"{got['s']} splits")
    if got["n"] != source_rows:
        raise ValueError(f"{got['n']} of {source_rows} rows")
    classes = flow.groupBy("Attack").agg(F.countDistinct("split").alias("s")).where(F.col("s") < len(SPLITS)).limit(5).collect()
    if classes:
        raise ValueError(f"classes that a split lacks: {[r['Attack'] for r in classes]}")
    if not audit.shared_keys(flow, "flow_group_id").isEmpty():
        raise ValueError("a group stands in two splits")


def prepare(spark: SparkSession, source: str, out: str, caps: dict[str, int] = splitting.PILOT_CAPS) -> dict:
    """Group-hash split (out/full/split=...), pilot sample (out/pilot), and a manifest with counts, conflicts and address overlap."""
    if sinks.exists(spark, out):
        raise FileExistsError(out)
    flows = require_columns(spark.read.parquet(source), [*FEATURES, SRC_IP, SRC_PORT, DST_IP, DST_PORT, "Label", "Attack", "Dataset", "source_row_id", "flow_group_id"])
    sinks.partitioned(flows.withColumn("split", splitting.group_split(F.col("flow_group_id"))), f"{out}/full", "split")
    flow = readers.split_parquet(spark, f"{out}/full")
    check_split(flow, flows.count())
    sinks.partitioned(splitting.pilot_sample(flow, caps), f"{out}/pilot", "split")
    splits = spark.createDataFrame([(s,) for s in SPLITS], "split string")
    overlap = {s: audit.endpoint_overlap(flow.where("split = 'train'"), flow.where(F.col("split") == s), [SRC_IP, DST_IP]).first().asDict() for s in ("val", "test")}
    report = {"counts": _counts(flow, "split", "Attack"), "pilot": _counts(spark.read.parquet(f"{out}/pilot"), "split", "Attack"), "conflicts": [r.asDict() for r in audit.label_conflicts(flow, splits, "flow_group_id", "Attack").orderBy("split").collect()], "overlap": overlap}
    sinks.manifest(spark, report, f"{out}/manifest.json")
    return report


def endpoint_holdout(spark: SparkSession, source: str, out: str, seed: int = splitting.HOLDOUT_SEED, least: int = 30) -> dict:
    """Rows whose addresses fall in one split by hash (out/full), with retained share and eligible classes; a shared address raises."""
    if sinks.exists(spark, out):
        raise FileExistsError(out)
    flows = spark.read.parquet(source).drop("split")
    sinks.partitioned(splitting.endpoint_holdout(flows, SRC_IP, DST_IP, seed), f"{out}/full", "split")
    held = readers.split_parquet(spark, f"{out}/full")
    ips = held.select(F.explode(F.array(SRC_IP, DST_IP)).alias("ip"), "split")
    if not audit.shared_keys(ips, "ip").isEmpty():
        raise ValueError("an address stands in two splits")
    n, kept = flows.count(), held.count()
    report = {"rows": n, "kept": kept, "retained": kept / n if n else 0.0, "classes": [r.asDict() for r in audit.eligibility(held, SPLITS, "Attack", least).orderBy("Attack").collect()]}
    sinks.manifest(spark, report, f"{out}/manifest.json")
    return report


def _rewire(spark: SparkSession, source: str, out: str, seed: int = 20260928) -> dict:
    """`rewire`, whose intermediate tables are left to the caller's scope."""
    if sinks.exists(spark, out):
        raise FileExistsError(out)
    before = spark.read.parquet(source)
    sinks.partitioned(graph.rewired(before, seed), f"{out}/full", "split")
    after = spark.read.parquet(f"{out}/full")
    gates = graph.rewire_gates(before, after, [SRC_IP, SRC_PORT, *FEATURES, "Label", "Attack", "Dataset", "flow_group_id"]).first().asDict()
    bad = [k for k in ("repeated_ids", "protected_mismatches", "marginal_difference") if gates[k]]
    if gates["rows_before"] != gates["rows_after"]:
        bad.append("rows")
    if gates["rows_before"] and not gates["changed"]:
        bad.append("changed")
    if bad:
        sinks.remove(spark, out)
        raise ValueError(f"gates failed: {', '.join(bad)}")
    sinks.manifest(spark, gates, f"{out}/manifest.json")
    return gates


def rewire(spark: SparkSession, source: str, out: str, seed: int = 20260928) -> dict:
    """Destinations permuted within Dataset and split (out/full), published only if every gate holds."""
    with scope(spark):
        return _rewire(spark, source, out, seed)


@dataclass(frozen=True)
class Stage:
    """A step of a run: what it does, and how to tell that it is complete."""

    name: str
    run: Callable[[], object]
    complete: Callable[[], bool]


def run_stages(stages: list[Stage], gate: Callable[[str], list[str]] = lambda _: []) -> list[str]:
    """Runs what is not complete, in order; the names of the stages that ran. Reasons of the gate stop it, as does a stage that leaves itself incomplete."""
    ran = []
    for s in stages:
        if s.complete():
            continue
        if why := gate(s.name):
            raise RuntimeError(f"{s.name}: {', '.join(why)}")
        s.run()
        if not s.complete():
            raise RuntimeError(f"{s.name} ended incomplete")
        ran.append(s.name)
    return ran
