"""Queries of the training-data problems, and the SQL of those that SQL expresses on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.functions import canon
from flowloom.llm.bpe import encode_documents
from flowloom.llm.clusters import split_clusters, split_clusters_sql, whole_clusters_sql
from flowloom.llm.mixing import mix
from flowloom.llm.overlap import overlap_pairs, overlap_pairs_sql, overlap_report, overlap_report_sql
from flowloom.llm.quality import Profiles, learn, text_kinds, text_statistics, text_statistics_sql
from flowloom.llm.splits import assign_splits, wholeness
from flowloom.llm.stable import stable_sample, stable_sample_sql
from flowloom.llm.targets import REPORT, Target, draw, placed_rows, plan_sample, prepared
from flowloom.session import table


def _shares(spark: SparkSession, sf_dir: str) -> list[tuple[str, float]]:
    """The target table of split names, a few rows at every scale."""
    return [(r["split"], r["target_share"]) for r in table(spark, sf_dir, "split_shares").collect()]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of clusters that the stored split tears apart, with the cluster's smallest host."""
    return split_clusters(table(spark, sf_dir, "full_splits"))


def p2_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split for every row that keeps clusters whole."""
    return assign_splits(table(spark, sf_dir, "full_splits"), _shares(spark, sf_dir))[0]


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, shares and label shares reached by p2_assign, against the target shares."""
    shares = table(spark, sf_dir, "split_shares")
    flows = table(spark, sf_dir, "full_splits")
    got = assign_splits(flows, _shares(spark, sf_dir))[1]
    n = flows.count()
    part = lambda a, b: F.round(F.when(b > 0, a / b), 6)
    return shares.join(F.broadcast(got), "split", "left").select(
        "split", "target_share", F.coalesce("n", F.lit(0)).alias("n"), part(F.coalesce("n", F.lit(0)), F.lit(n)).alias("share"), part(F.col("n1"), F.col("n0") + F.col("n1")).alias("attack_share")
    )


def p2_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and clusters of p2_assign, and how many clusters it tears."""
    return wholeness(table(spark, sf_dir, "full_splits"), _shares(spark, sf_dir))


FIELDS = ("Attack", "Label")


def _targets(spark: SparkSession, sf_dir: str) -> list[Target]:
    """The table of sampling plans, the same few rows at every scale. Classes are compared by letters and digits, labels as text."""
    key = F.when(F.col("category_field") == "Attack", canon.word_key("category")).otherwise(F.col("category"))
    return [Target(**r.asDict()) for r in table(spark, sf_dir, "sampling_targets").withColumn("key", key).collect()]


def _plan_rows(spark: SparkSession, sf_dir: str, targets: list[Target]) -> DataFrame:
    fields = {"Attack": canon.word_key("Attack"), "Label": F.col("Label").cast("string")}
    return prepared(table(spark, sf_dir, "full_splits"), F.col("source_row_id"), canon.split_name("split"), fields, targets)


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per target: rows available and drawn, and whether the category falls short."""
    targets = _targets(spark, sf_dir)
    report = plan_sample(_plan_rows(spark, sf_dir, targets), list(FIELDS), targets)[1]
    return spark.createDataFrame(report, REPORT)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets that their split cannot meet."""
    return p3_report(spark, sf_dir).where("short").select("plan_id", "split", "category")


def p3_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows drawn for each plan."""
    targets = _targets(spark, sf_dir)
    rows = _plan_rows(spark, sf_dir, targets)
    placed = placed_rows(rows, list(FIELDS), targets)
    quotas, _ = plan_sample(rows, list(FIELDS), targets, placed)
    return draw(rows, list(FIELDS), targets, quotas, placed).select("plan_id", "source_row_id")


def p3_supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each target can count on: rows of its split, size of the sample, rows of the category, and whether that is too few."""
    return p3_report(spark, sf_dir).select("plan_id", "split", "category_field", "category", "split_rows", "size", "available", "short")


def _p3_sql(columns: str, only: str = "") -> str:
    have = f"""(SELECT count(*) FROM flow WHERE flow.split = t.split AND
      CASE WHEN t.category_field = 'Attack' THEN word = {canon.word_key_sql("t.category")} ELSE CAST(label AS VARCHAR) = t.category END)"""
    return f"""
WITH flow AS (SELECT {canon.split_name_sql("split")} AS split, {canon.word_key_sql("Attack")} AS word, Label AS label FROM full_splits),
n AS (SELECT *, (SELECT count(*) FROM flow WHERE flow.split = s.split) AS split_rows FROM sampling_targets s),
t AS (SELECT *, split_rows * sample_pct // 100 AS size FROM n),
c AS (SELECT *, {have} AS available FROM t),
d AS (SELECT *, available * 100 < target_pct * size OR available < min_rows AS short FROM c)
SELECT {columns} FROM d{only}"""


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a train row and an evaluation row that are the same or almost."""
    return overlap_pairs(table(spark, sf_dir, "full_splits"))


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation rows that occur in train, counted by split, Dataset and class."""
    return overlap_report(table(spark, sf_dir, "full_splits"))


STABLE_SHARE = 0.1


def p1_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the flows, after the late delivery has been added."""
    return stable_sample([table(spark, sf_dir, t) for t in ("full_splits", "late_flows")], STABLE_SHARE)


def p1_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sample before the late delivery."""
    return stable_sample([table(spark, sf_dir, "full_splits")], STABLE_SHARE)


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every document."""
    return encode_documents(table(spark, sf_dir, "documents"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy of a document in each mix."""
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of tokens reached by source in each mix."""
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def _common(spark: SparkSession, sf_dir: str) -> dict[str, list[str]]:
    """The fixed table of frequent words by language."""
    out: dict[str, list[str]] = {}
    for r in table(spark, sf_dir, "common_words").orderBy("lang", "word").collect():
        out.setdefault(r["lang"], []).append(r["word"])
    return out


def _profiles(spark: SparkSession, sf_dir: str) -> Profiles:
    return learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_kinds"), _common(spark, sf_dir))


def p8_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of every document, its distance from the nearest profile and from prose."""
    kinds = text_kinds(table(spark, sf_dir, "documents"), _profiles(spark, sf_dir))
    return kinds.select("doc_id", "kind", F.round("distance", 6).alias("distance"), F.round("prose_divergence", 6).alias("prose_divergence"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are lists, tables or junk."""
    return text_kinds(table(spark, sf_dir, "documents"), _profiles(spark, sf_dir)).where("kind <> 'prose'").select("doc_id", "kind")


def p8_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and shares of every document."""
    words = [w for ws in _common(spark, sf_dir).values() for w in ws]
    return text_statistics(table(spark, sf_dir, "documents"), words)


QUERIES = {
    f.__name__: f
    for f in (p1_sample, p1_before, p2_found, p2_assign, p2_whole, p2_report, p3_found, p3_supply, p3_report, p3_sample, p5_found, p5_report, p6_ids, p7_mix, p7_report, p8_found, p8_kinds, p8_stats)
}
SQL = {
    "p1_sample": stable_sample_sql(["full_splits", "late_flows"], STABLE_SHARE),
    "p1_before": stable_sample_sql(["full_splits"], STABLE_SHARE),
    "p2_found": split_clusters_sql("full_splits"),
    "p2_whole": whole_clusters_sql("full_splits"),
    "p3_found": _p3_sql("plan_id, split, category", " WHERE short"),
    "p3_supply": _p3_sql("plan_id, split, category_field, category, split_rows, size, available, short"),
    "p5_found": overlap_pairs_sql("full_splits"),
    "p5_report": overlap_report_sql("full_splits"),
    "p8_stats": text_statistics_sql("documents", "common_words"),
}
