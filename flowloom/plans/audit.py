"""Audits: counts, duplicates, conflicts, leaks, integrity, set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom import schema
from flowloom.operators import audit as A
from flowloom.operators.validation import nonfinite
from flowloom.plans.registry import Registry, Tables
from flowloom.plans.splitting import class_codes

Q = Registry()
n_rows = A.n_rows


@Q("a1_count", "SELECT count(*) AS n FROM full_splits")
def count(t: Tables) -> DataFrame:
    """Rows of the table."""
    return t.full_splits.agg(n_rows().alias("n"))


@Q("a2_split_class_counts", "WITH flow SELECT split, Attack, count(*) AS n FROM flow GROUP BY ALL ORDER BY split, Attack")
def split_class_counts(t: Tables) -> DataFrame:
    """Rows by split and class."""
    return t.flow.groupBy("split", "Attack").agg(n_rows().alias("n")).orderBy("split", "Attack")


@Q("a3_dataset_class_counts", "SELECT Dataset, Attack, count(*) AS n FROM full_splits GROUP BY ALL")
def dataset_class_counts(t: Tables) -> DataFrame:
    """Rows by Dataset and class, missing ones as groups of their own."""
    return t.full_splits.groupBy("Dataset", "Attack").agg(n_rows().alias("n"))


@Q("a4_dataset_counts", "SELECT Dataset, count(*) AS n FROM full_splits GROUP BY 1")
def dataset_counts(t: Tables) -> DataFrame:
    """Rows by Dataset."""
    return t.full_splits.groupBy("Dataset").agg(n_rows().alias("n"))


@Q("a5_audit_row", """
SELECT count(*) AS rows, count(DISTINCT source_row_id) AS ids, count(DISTINCT flow_group_id) AS groups, min(L4_SRC_PORT) AS min_src_port, max(L4_SRC_PORT) AS max_src_port,
  min(L4_DST_PORT) AS min_dst_port, max(L4_DST_PORT) AS max_dst_port, count(*) FILTER (WHERE Label = 0) AS benign, count(*) FILTER (WHERE Label = 1) AS attacks,
  count(*) FILTER (WHERE Attack IS NULL) AS no_class, count(*) FILTER (WHERE Label <> (Attack <> 'Benign')::INT) AS contradictions FROM full_splits""")
def audit_row(t: Tables) -> DataFrame:
    """The audit of a flow table in one row."""
    return A.audit_row(t.full_splits)


@Q("a6_filtered_counts", "SELECT Dataset, count(*) FILTER (WHERE Label = 1) AS attacks, count(*) FILTER (WHERE L4_DST_PORT < 1024) AS low_ports FROM full_splits GROUP BY 1")
def filtered_counts(t: Tables) -> DataFrame:
    """Several conditional counts in one pass."""
    return t.full_splits.groupBy("Dataset").agg(F.count_if(F.col("Label") == 1).alias("attacks"), F.count_if(F.col("L4_DST_PORT") < 1024).alias("low_ports"))


@Q("a7_filtered_distincts", "WITH flow SELECT flow_group_id, count(DISTINCT Attack) FILTER (WHERE split = 'train') AS train_classes, min(source_row_id) FILTER (WHERE split = 'train') AS first_train_row FROM flow GROUP BY 1")
def filtered_distincts(t: Tables) -> DataFrame:
    """Per group the classes and the first row in train."""
    train = F.col("split") == "train"
    return t.flow.groupBy("flow_group_id").agg(F.countDistinct(F.when(train, F.col("Attack"))).alias("train_classes"), F.min(F.when(train, F.col("source_row_id"))).alias("first_train_row"))


@Q("a8_duplicate_stats", """
WITH g AS (SELECT flow_group_id, count(*) AS n, min(Attack) AS lo, max(Attack) AS hi FROM full_splits GROUP BY 1)
SELECT count(*) AS groups, CAST(sum(n - 1) AS BIGINT) AS extra, count(*) FILTER (WHERE n > 1) AS repeated, count(*) FILTER (WHERE lo <> hi) AS conflicting FROM g""")
def duplicate_stats(t: Tables) -> DataFrame:
    """Groups, rows beyond the first, repeated and conflicting groups: aggregated per group, then over all."""
    g = A.group_states(t.full_splits, "flow_group_id", "Attack")
    return g.agg(n_rows().alias("groups"), F.sum(F.col("n") - 1).alias("extra"), F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(F.col("lo") != F.col("hi")).alias("conflicting"))


@Q("a9_excess_duplicates", "SELECT count(*) AS groups, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS excess FROM (SELECT flow_group_id, count(*) AS n FROM full_splits GROUP BY 1 HAVING count(*) > 1)")
def excess(t: Tables) -> DataFrame:
    """Repeated groups and their excess rows."""
    return A.excess_duplicates(t.full_splits, "flow_group_id")


@Q("a10_label_conflicts", """
WITH flow, bad AS (SELECT split, flow_group_id, count(*) AS n FROM flow GROUP BY ALL HAVING min(Attack) <> max(Attack))
SELECT s.split, count(bad.n) AS groups, CAST(coalesce(sum(bad.n), 0) AS BIGINT) AS rows FROM split_shares s LEFT JOIN bad ON bad.split = s.split GROUP BY 1""".replace("WITH flow,", "WITH flow ,"))
def label_conflicts(t: Tables) -> DataFrame:
    """Groups of one split with several classes, 0 for splits without any."""
    return A.label_conflicts(t.flow, t.split_shares.select("split"), "flow_group_id", "Attack")


@Q("a11_split_leak", "WITH flow SELECT flow_group_id, count(DISTINCT split) AS splits FROM flow WHERE flow_group_id IS NOT NULL AND split IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) > 1")
def split_leak(t: Tables) -> DataFrame:
    """Groups that stand in several splits."""
    return A.shared_keys(t.flow, "flow_group_id")


@Q("a11_endpoint_leak", """
WITH flow SELECT count(*) AS leaking FROM (SELECT ip FROM (SELECT IPV4_SRC_ADDR AS ip, split FROM flow UNION ALL SELECT IPV4_DST_ADDR, split FROM flow)
WHERE ip IS NOT NULL AND split IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) > 1)""")
def endpoint_leak(t: Tables) -> DataFrame:
    """How many addresses stand in several splits, as source or destination."""
    both = t.flow.select(F.explode(F.array("IPV4_SRC_ADDR", "IPV4_DST_ADDR")).alias("ip"), "split")
    return A.shared_keys(both, "ip").agg(n_rows().alias("leaking"))


@Q("a12_uniqueness", "SELECT count(*) - count(DISTINCT source_row_id) AS repeats FROM full_splits")
def uniqueness(t: Tables) -> DataFrame:
    """Rows beyond the distinct ids."""
    return t.full_splits.agg((n_rows() - F.countDistinct("source_row_id")).alias("repeats"))


@Q("a13_conditional_sums", """
SELECT Dataset, CAST(sum(CASE WHEN IPV4_SRC_ADDR IS NOT DISTINCT FROM IPV4_DST_ADDR THEN 1 ELSE 0 END) AS BIGINT) AS same_host,
  CAST(coalesce(sum(CASE WHEN Label = 1 THEN IN_BYTES END), 0) AS BIGINT) AS attack_bytes FROM full_splits GROUP BY 1""")
def conditional_sums(t: Tables) -> DataFrame:
    """Sums under conditions, null as 0."""
    return t.full_splits.groupBy("Dataset").agg(
        F.sum(F.when(F.col("IPV4_SRC_ADDR").eqNullSafe(F.col("IPV4_DST_ADDR")), 1).otherwise(0)).alias("same_host"),
        F.coalesce(F.sum(F.when(F.col("Label") == 1, F.col("IN_BYTES"))), F.lit(0)).cast("bigint").alias("attack_bytes"),
    )


@Q("a14_ratios", "WITH flow SELECT split, round(count(*) FILTER (WHERE Label = 1) / count(*), 9) AS attack_share FROM flow GROUP BY 1")
def ratios(t: Tables) -> DataFrame:
    """The share of attacks by split."""
    return t.flow.groupBy("split").agg(A.ratio(F.count_if(F.col("Label") == 1), n_rows()).alias("attack_share"))


_EXTREMES = ("IN_BYTES", "OUT_PKTS", "MAX_TTL", "L7_PROTO")


@Q("a15_column_extremes", "SELECT " + ", ".join(f"min({c}) FILTER (WHERE isfinite({c}::DOUBLE)) AS min_{c}, max({c}) FILTER (WHERE isfinite({c}::DOUBLE)) AS max_{c}, count(*) FILTER (WHERE {c} IS NULL OR NOT isfinite({c}::DOUBLE)) AS bad_{c}" for c in _EXTREMES) + " FROM full_splits")
def column_extremes(t: Tables) -> DataFrame:
    """Extremes of finite values, and how many are not finite, of four features; `a15_feature_extremes` has all."""
    return t.full_splits.agg(*extremes(_EXTREMES))


def extremes(columns) -> list[Column]:
    """For each column the extremes of finite values in its own type, null if there are none, and how many are not finite."""
    out = []
    for c in columns:
        ok = F.when(~nonfinite(c), F.col(c))
        out += [F.min(ok).alias(f"min_{c}"), F.max(ok).alias(f"max_{c}"), F.count_if(nonfinite(c)).alias(f"bad_{c}")]
    return out


@Q("a15_feature_extremes", "SELECT " + ", ".join(f"min({c}) FILTER (WHERE isfinite({c}::DOUBLE)) AS min_{c}, max({c}) FILTER (WHERE isfinite({c}::DOUBLE)) AS max_{c}, count(*) FILTER (WHERE {c} IS NULL OR NOT isfinite({c}::DOUBLE)) AS bad_{c}" for c in schema.FEATURES) + " FROM full_splits")
def feature_extremes(t: Tables) -> DataFrame:
    """Extremes and bad values of all 39 features in one pass."""
    return t.full_splits.agg(*extremes(schema.FEATURES))


@Q("a24_distinct_per_group", "SELECT dataset, task, model, count(DISTINCT seed) AS seeds, count(*) - count(DISTINCT seed) AS repeats FROM runs GROUP BY ALL")
def distinct_per_group(t: Tables) -> DataFrame:
    """Seeds of each cell of the run table, and repeated keys."""
    return t.runs.groupBy("dataset", "task", "model").agg(F.countDistinct("seed").alias("seeds"), (n_rows() - F.countDistinct("seed")).alias("repeats"))


@Q("a38_split_gates", """
WITH flow SELECT (SELECT count(DISTINCT split) FROM flow) = 3 AS all_splits, (SELECT count(*) FROM flow WHERE split IS NOT NULL) = (SELECT count(*) FROM full_splits) AS rows_conserved,
  (SELECT count(*) FROM (SELECT Attack FROM flow WHERE split IS NOT NULL AND Attack IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) < 3)) = 0 AS classes_covered,
  (SELECT count(*) FROM (SELECT flow_group_id FROM flow WHERE flow_group_id IS NOT NULL AND split IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) > 1)) = 0 AS groups_whole""")
def split_gates(t: Tables) -> DataFrame:
    """The gates of a split: all splits, all rows, every class in each, no group in two. Each part is one row."""
    one = t.flow.agg((F.countDistinct("split") == 3).alias("all_splits"), (F.count("split") == n_rows()).alias("rows_conserved"))
    classes = t.flow.where("split IS NOT NULL AND Attack IS NOT NULL").groupBy("Attack").agg(F.countDistinct("split").alias("s")).agg((F.count_if(F.col("s") < 3) == 0).alias("classes_covered"))
    groups = A.shared_keys(t.flow, "flow_group_id").agg((n_rows() == 0).alias("groups_whole"))
    return A.beside(one, classes, groups)


@Q("a41_class_counts_map", "WITH flow SELECT split, Attack AS class, count(*) AS n FROM flow WHERE Attack IS NOT NULL GROUP BY ALL")
def class_counts_map(t: Tables) -> DataFrame:
    """Class counts as a map per split, as a manifest holds them, read back as rows."""
    per = t.flow.where("Attack IS NOT NULL").groupBy("split", "Attack").agg(n_rows().alias("n"))
    maps = per.groupBy("split").agg(F.map_from_entries(F.collect_list(F.struct("Attack", "n"))).alias("counts"))
    return maps.select("split", F.explode("counts").alias("class", "n"))


@Q("j1_left_join_overlap", """
WITH flow, tr AS (SELECT DISTINCT IPV4_SRC_ADDR AS ip FROM flow WHERE split = 'train' AND IPV4_SRC_ADDR IS NOT NULL UNION SELECT DISTINCT IPV4_DST_ADDR FROM flow WHERE split = 'train' AND IPV4_DST_ADDR IS NOT NULL),
te AS (SELECT DISTINCT IPV4_SRC_ADDR AS ip FROM flow WHERE split = 'test' AND IPV4_SRC_ADDR IS NOT NULL UNION SELECT DISTINCT IPV4_DST_ADDR FROM flow WHERE split = 'test' AND IPV4_DST_ADDR IS NOT NULL)
SELECT te.ip, tr.ip IS NOT NULL AS known FROM te LEFT JOIN tr USING (ip)""".replace("WITH flow,", "WITH flow ,"))
def left_join_overlap(t: Tables) -> DataFrame:
    """Addresses of test, and whether train has them."""
    ips = lambda s: t.flow.where(F.col("split") == s).select(F.explode(F.array("IPV4_SRC_ADDR", "IPV4_DST_ADDR")).alias("ip")).where("ip IS NOT NULL").distinct()
    return ips("test").join(ips("train").withColumn("known", F.lit(True)), "ip", "left").fillna(False, ["known"])


_IPS = "(SELECT DISTINCT ip FROM (SELECT IPV4_SRC_ADDR AS ip, split FROM flow UNION ALL SELECT IPV4_DST_ADDR, split FROM flow) WHERE ip IS NOT NULL AND split = '{}')"


@Q("g11_ip_overlap", f"WITH flow SELECT count(*) AS held_ips, count(b.ip) AS known_ips, round(count(b.ip) / count(*), 9) AS overlap FROM {_IPS.format('test')} a LEFT JOIN {_IPS.format('train')} b USING (ip)")
def ip_overlap(t: Tables) -> DataFrame:
    """The overlap of test's addresses with train's."""
    return A.endpoint_overlap(t.flow.where("split = 'train'"), t.flow.where("split = 'test'"), ["IPV4_SRC_ADDR", "IPV4_DST_ADDR"])


@Q("j5_disjoint_ids", "WITH flow SELECT a.split AS a, b.split AS b, (SELECT count(*) FROM (SELECT flow_group_id FROM flow WHERE split = a.split INTERSECT SELECT flow_group_id FROM flow WHERE split = b.split)) AS shared FROM split_shares a, split_shares b WHERE a.split < b.split")
def disjoint_ids(t: Tables) -> DataFrame:
    """Groups shared by each pair of splits, from the set of splits of each group."""
    sets = t.flow.where("split IS NOT NULL").groupBy(F.coalesce("flow_group_id", F.lit("?")).alias("g")).agg(F.collect_set("split").alias("s"))
    pairs = [("test", "train"), ("test", "val"), ("train", "val")]
    has = lambda a, b: F.count_if(F.array_contains("s", a) & F.array_contains("s", b))
    one = sets.agg(*[has(a, b).alias(f"n{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"n{i}").alias("shared")) for i, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")


_PROTECTED = (schema.SRC_IP, schema.SRC_PORT, *schema.FEATURES, "Label", "Attack", "Dataset", "flow_group_id")
_DIFF = " OR ".join(f"a.{c} IS DISTINCT FROM b.{c}" for c in _PROTECTED)


@Q("j3_redelivered_diff", f"""
SELECT count(*) AS rows, count(*) FILTER (WHERE {_DIFF}) AS changed, count(*) FILTER (WHERE a.split IS DISTINCT FROM b.split) AS resplit
FROM full_splits a JOIN late_flows b USING (source_row_id)""")
def redelivered_diff(t: Tables) -> DataFrame:
    """Rows delivered twice whose protected columns differ, null being equal to null."""
    a, b = t.full_splits.alias("a"), t.late_flows.alias("b")
    changed = A.any_differs([(F.col(f"a.{c}"), F.col(f"b.{c}")) for c in _PROTECTED])
    both = a.join(b, F.col("a.source_row_id") == F.col("b.source_row_id"))
    return both.agg(n_rows().alias("rows"), F.count_if(changed).alias("changed"), F.count_if(~F.col("a.split").eqNullSafe(F.col("b.split"))).alias("resplit"))


@Q("p17_protected_diff", f"SELECT source_row_id FROM full_splits a JOIN late_flows b USING (source_row_id) WHERE {_DIFF}")
def protected_diff(t: Tables) -> DataFrame:
    """Which rows those are."""
    a, b = t.full_splits.alias("a"), t.late_flows.alias("b")
    changed = A.any_differs([(F.col(f"a.{c}"), F.col(f"b.{c}")) for c in _PROTECTED])
    return a.join(b, F.col("a.source_row_id") == F.col("b.source_row_id")).where(changed).select("a.source_row_id")


@Q("j6_code_lookup", "WITH c AS (SELECT Attack, CAST(row_number() OVER (ORDER BY Attack) - 1 AS BIGINT) AS code FROM (SELECT DISTINCT Attack FROM full_splits WHERE Attack IS NOT NULL)) SELECT source_row_id, code FROM full_splits LEFT JOIN c USING (Attack)")
def code_lookup(t: Tables) -> DataFrame:
    """Class codes looked up for every row."""
    return t.full_splits.select("source_row_id", "Attack").join(class_codes(t), "Attack", "left").select("source_row_id", "code")


@Q("u1_distinct_union", "SELECT IPV4_SRC_ADDR AS ip FROM full_splits UNION SELECT IPV4_DST_ADDR FROM full_splits")
def distinct_union(t: Tables) -> DataFrame:
    """All addresses once."""
    return t.full_splits.select(F.col("IPV4_SRC_ADDR").alias("ip")).union(t.full_splits.select("IPV4_DST_ADDR")).distinct()


@Q("u2_tagged_union", "SELECT side, count(*) AS n, count(ip) AS known FROM (SELECT 'src' AS side, IPV4_SRC_ADDR AS ip FROM full_splits UNION ALL SELECT 'dst', IPV4_DST_ADDR FROM full_splits) GROUP BY 1")
def tagged_union(t: Tables) -> DataFrame:
    """Both sides with a tag."""
    sides = t.full_splits.select(F.lit("src").alias("side"), F.col("IPV4_SRC_ADDR").alias("ip")).unionByName(t.full_splits.select(F.lit("dst").alias("side"), F.col("IPV4_DST_ADDR").alias("ip")))
    return sides.groupBy("side").agg(n_rows().alias("n"), F.count("ip").alias("known"))


@Q("u3_marginal_diff", "SELECT IPV4_DST_ADDR, L4_DST_PORT FROM ((SELECT IPV4_DST_ADDR, L4_DST_PORT FROM late_flows EXCEPT ALL SELECT IPV4_DST_ADDR, L4_DST_PORT FROM full_splits) UNION ALL (SELECT IPV4_DST_ADDR, L4_DST_PORT FROM full_splits EXCEPT ALL SELECT IPV4_DST_ADDR, L4_DST_PORT FROM late_flows))")
def marginal_diff(t: Tables) -> DataFrame:
    """The multiset difference of destination tuples in both directions."""
    cols = ("IPV4_DST_ADDR", "L4_DST_PORT")
    return A.multiset_difference(t.full_splits.select(*cols), t.late_flows.select(*cols))


@Q("u4_concatenation", "SELECT count(*) AS n, count(DISTINCT source_row_id) AS ids FROM (SELECT source_row_id FROM full_splits UNION ALL SELECT source_row_id FROM late_flows)")
def concatenation(t: Tables) -> DataFrame:
    """Two tables one after the other, by name."""
    both = t.full_splits.unionByName(t.late_flows).select("source_row_id")
    return both.agg(n_rows().alias("n"), F.countDistinct("source_row_id").alias("ids"))


@Q("u5_run_union", "WITH u AS (SELECT dataset, task, model, seed FROM runs WHERE seed <= 22 UNION ALL SELECT dataset, task, model, seed FROM runs WHERE seed > 11) SELECT dataset, task, model, seed, count(*) AS copies FROM u GROUP BY ALL HAVING count(*) > 1")
def run_union(t: Tables) -> DataFrame:
    """Two sets of runs put together, and the keys that then repeat."""
    keys = ["dataset", "task", "model", "seed"]
    both = t.runs.where("seed <= 22").select(*keys).unionByName(t.runs.where("seed > 11").select(*keys))
    return both.groupBy(*keys).agg(n_rows().alias("copies")).where("copies > 1")


@Q("u7_column_difference", "SELECT column_name AS missing FROM (DESCRIBE full_splits) WHERE column_name NOT IN (SELECT column_name FROM (DESCRIBE rejected_rows))")
def column_difference(t: Tables) -> DataFrame:
    """Columns of one table that another lacks: read from the schemas."""
    missing = sorted(set(t.full_splits.columns) - set(t.rejected_rows.columns))
    return t.spark.createDataFrame([(c,) for c in missing], "missing string")


@Q("r10_matrix_completeness", """
SELECT (SELECT count(*) FROM runs) AS rows, (SELECT count(DISTINCT dataset) * count(DISTINCT task) * count(DISTINCT model) * count(DISTINCT seed) FROM runs) AS cells,
  (SELECT count(*) FROM (SELECT 1 FROM runs GROUP BY dataset, task, model, seed HAVING count(*) > 1)) AS repeated_keys""")
def matrix_completeness(t: Tables) -> DataFrame:
    """Rows against the full product of the keys, and repeated keys."""
    keys = ["dataset", "task", "model", "seed"]
    one = t.runs.agg(n_rows().alias("rows"), (F.countDistinct("dataset") * F.countDistinct("task") * F.countDistinct("model") * F.countDistinct("seed")).alias("cells"))
    bad = t.runs.groupBy(*keys).count().where("count > 1").agg(n_rows().alias("repeated_keys"))
    return A.beside(one, bad)


@Q("r14_expected_inventory", """
WITH e(Dataset, expected) AS (VALUES ('NF-BoT-IoT-v2', 1000), ('NF-ToN-IoT-v2', 1000), ('NF-CSE-CIC-IDS2018-v2', 1000), ('NF-UNSW-NB15-v2', 1000))
SELECT e.Dataset, e.expected, (SELECT count(*) FROM full_splits f WHERE f.Dataset = e.Dataset) AS n, (SELECT count(*) FROM full_splits f WHERE f.Dataset = e.Dataset) = e.expected AS equal FROM e""")
def expected_inventory(t: Tables) -> DataFrame:
    """Counts against an expected inventory, held as a literal."""
    expected = t.spark.createDataFrame([(d, 1000) for d in schema.DATASETS], "Dataset string, expected int")
    have = t.full_splits.groupBy("Dataset").agg(n_rows().alias("n"))
    return expected.join(have, "Dataset", "left").fillna(0, ["n"]).withColumn("equal", F.col("n") == F.col("expected"))


QUERIES, SQL = Q.queries, Q.sql
