"""Clusters of rows linked through a flow group or a host.

Rows hang on hosts, and hosts are joined by edges: source to destination of a row, and every host of a flow group to
the group's smallest host. So the graph that is iterated over has hosts (at most 2**32) as its nodes, not rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.functions import canon
from flowloom.session import discard, materialize

SPLIT_BIT = {"train": 1, "val": 2, "test": 4}


def linked_rows(flows: DataFrame) -> DataFrame:
    """(id, g, s, d, bit, label): row id, 16-byte flow group, linking source and destination host, split bit, label.

    A missing group, a missing address, or one that names no single host is null and links nothing. A row without a
    split has bit 0.
    """
    name = canon.split_name("split")
    bit = F.lit(0)
    for s, b in SPLIT_BIT.items():
        bit = F.when(name == s, b).otherwise(bit)
    return flows.select(
        F.col("source_row_id").alias("id"),
        F.unhex(canon.group_key("flow_group_id")).alias("g"),
        canon.linking_host("IPV4_SRC_ADDR").alias("s"),
        canon.linking_host("IPV4_DST_ADDR").alias("d"),
        bit.alias("bit"),
        F.col("Label").cast("bigint").alias("label"),
    )


def _groups(rows: DataFrame) -> DataFrame:
    """Per flow group its extreme hosts, how many rows have both hosts, and how many have none."""
    return rows.where("g IS NOT NULL").groupBy("g").agg(
        F.min("s").alias("s0"), F.max("s").alias("s1"), F.min("d").alias("d0"), F.max("d").alias("d1"),
        F.count_if(F.col("s").isNotNull() & F.col("d").isNotNull()).alias("both"),
        F.count_if(F.col("s").isNull() & F.col("d").isNull()).alias("none"),
    )


def host_edges(rows: DataFrame) -> DataFrame:
    """Distinct edges (u, v) with u > v between hosts that a row or a flow group links."""
    groups = _groups(rows)
    own = rows.select(F.col("s").alias("u"), F.col("d").alias("v"))
    # A group with one source and one destination is linked by any row that has both, else by this edge.
    halves = groups.where("both = 0").select(F.col("s0").alias("u"), F.col("d0").alias("v"))
    mixed = groups.where("s0 < s1 OR d0 < d1").select("g", F.least("s0", "d0").alias("v"))
    spread = rows.where("g IS NOT NULL").select("g", F.explode(F.array("s", "d")).alias("u")).where("u IS NOT NULL").join(mixed, "g").select("u", "v")
    edges = own.unionByName(halves).unionByName(spread).where("u <> v")
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of an edge table (u, v) is connected to; roots themselves included.

    Alternates large-star and small-star steps until the edges stay the same, which takes a number of rounds that is
    logarithmic in the number of nodes. Every round is written to the shared folder. A node with very many neighbours is joined with one row
    (its smallest neighbour), so the adaptive skew join splits it.
    """
    now, seal = materialize(edges.select(F.col("u").cast("bigint"), F.col("v").cast("bigint")), "edges"), None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        # Every edge of `large` points from the larger to the smaller node.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        small = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
        after = materialize(small, "edges")
        discard(now)
        now = after
        sealed = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sealed == seal:
            break
        seal = sealed
    out = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    result = out.unionByName(roots)
    result._flowloom_path = now._flowloom_path
    return result


def anchored(rows: DataFrame) -> DataFrame:
    """rows with `host`, the host by which a row belongs to its cluster: its own, else its group's smallest, else null."""
    orphans = rows.where("s IS NULL AND d IS NULL")
    homes = _groups(rows).where("none > 0").select("g", F.least("s0", "d0").alias("host"))
    own = rows.where("s IS NOT NULL OR d IS NOT NULL").withColumn("host", F.coalesce("s", "d"))
    return own.unionByName(orphans.join(homes, "g", "left"))


def host_roots(anchors: DataFrame, comp: DataFrame) -> DataFrame:
    """Per host: root, split bits, rows, and rows by label, all pre-aggregated; a host without edges is its own root."""
    one = anchors.where("host IS NOT NULL").groupBy("host").agg(
        F.bit_or("bit").alias("bits"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 0).alias("n0"), F.count_if(F.col("label") == 1).alias("n1")
    )
    return one.join(comp, one["host"] == comp["node"], "left").select("host", F.coalesce("root", "host").alias("root"), "bits", "n", "n0", "n1")


def split_clusters(flows: DataFrame) -> DataFrame:
    """(source_row_id, cluster_addr) of every row of a cluster whose rows stand in more than one split.

    cluster_addr is the smallest host of the cluster in dotted form, null for a cluster that has no host. Rows without a
    split count for none but are returned with their cluster. Rows without host and group are no cluster. Repeated row
    ids are returned as often as they occur. Empty input gives no rows; extra columns are ignored.
    """
    rows = materialize(linked_rows(flows), "rows")
    comp = components(host_edges(rows))
    anchors = anchored(rows)
    hosts = materialize(host_roots(anchors, comp), "hosts")
    mixed = hosts.groupBy("root").agg(F.bit_or("bits").alias("all")).where(F.bit_count("all") > 1).select("root")
    marked = hosts.select("host", "root").join(mixed, "root")
    by_host = anchors.where("host IS NOT NULL").join(marked, "host").select("id", "root")
    lone = anchors.where("host IS NULL AND g IS NOT NULL")
    torn = lone.groupBy("g").agg(F.bit_or("bit").alias("all")).where(F.bit_count("all") > 1).select("g")
    by_group = lone.join(torn, "g").select("id", F.lit(None).cast("bigint").alias("root"))
    return by_host.unionByName(by_group).select(F.col("id").alias("source_row_id"), canon.dotted(F.col("root")).alias("cluster_addr"))


def _clusters_sql(table: str) -> str:
    """Common table expressions for DuckDB: r (id, s, d, split, g) of every row and cc (node, root); the smallest node spreads over the links until nothing changes. Groups are numbered above all hosts."""
    return f"""
WITH RECURSIVE flow AS (SELECT source_row_id AS id, {canon.linking_host_sql("IPV4_SRC_ADDR")} AS s, {canon.linking_host_sql("IPV4_DST_ADDR")} AS d, {canon.group_key_sql("flow_group_id")} AS grp, {canon.split_name_sql("split")} AS split FROM {table}),
r AS MATERIALIZED (SELECT id, s, d, split, CASE WHEN grp IS NOT NULL THEN 8589934592 + dense_rank() OVER (ORDER BY grp) END AS g FROM flow),
e AS MATERIALIZED (SELECT DISTINCT a, b FROM (SELECT s AS a, d AS b FROM r UNION ALL SELECT d, s FROM r UNION ALL SELECT coalesce(s, d), g FROM r UNION ALL SELECT g, coalesce(s, d) FROM r) WHERE a <> b),
n AS (SELECT DISTINCT unnest([s, d, g]) AS node FROM r),
cc(node, root) USING KEY (node) AS (
  SELECT node, node FROM n WHERE node IS NOT NULL
  UNION
  (SELECT u.node, min(v.root) FROM recurring.cc u JOIN e ON e.a = u.node JOIN cc v ON v.node = e.b WHERE v.root < u.root GROUP BY u.node)
)"""


def split_clusters_sql(table: str) -> str:
    """`split_clusters` in SQL for DuckDB."""
    return f"""{_clusters_sql(table)},
c AS (SELECT r.id, r.split, cc.root FROM r JOIN cc ON cc.node = coalesce(r.s, r.d, r.g)),
torn AS (SELECT root FROM c GROUP BY root HAVING count(DISTINCT split) > 1)
SELECT id AS source_row_id, CASE WHEN root < 8589934592 THEN {canon.dotted_sql("root")} END AS cluster_addr FROM c WHERE root IN (SELECT root FROM torn)"""


def whole_clusters_sql(table: str) -> str:
    """What a split that tears nothing must have, in SQL for DuckDB: all rows, all clusters (a row that nothing links is one by itself), none torn."""
    return f"""{_clusters_sql(table)}
SELECT count(*) AS rows, count(DISTINCT cc.root) + count_if(cc.root IS NULL) AS clusters, 0 AS torn FROM r LEFT JOIN cc ON cc.node = coalesce(r.s, r.d, r.g)"""
