"""The multigraph of flows: edges keyed by row, nodes (ip, port)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.functions.hashing import digest, hash60
from flowloom.operators.audit import any_differs, beside, multiset_difference, n_rows
from flowloom.operators.skew import ordinals
from flowloom.schema import DST_IP, DST_PORT, SRC_IP, SRC_PORT


def node(ip: str, port: str) -> Column:
    """A node's key; its port separates services of one host."""
    return F.concat_ws(":", ip, F.col(port).cast("string"))


def label_edges(flow: DataFrame, *kept: str) -> DataFrame:
    """(source_row_id, src, dst, *kept), one edge per flow."""
    return flow.select("source_row_id", node(SRC_IP, SRC_PORT).alias("src"), node(DST_IP, DST_PORT).alias("dst"), *kept)


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def message_edges(edges: DataFrame) -> DataFrame:
    """Edges and their reverses, a self-loop once, parallel edges kept."""
    back = edges.where("src <> dst")
    swapped = back.withColumns({"src": F.col("dst"), "dst": F.col("src")})
    return edges.withColumn("reverse", F.lit(False)).unionByName(swapped.withColumn("reverse", F.lit(True)))


def dense_node_ids(edges: DataFrame) -> DataFrame:
    """(node, id): ids from 0 in the order of the keys, numbered over a range partition."""
    return ordinals(nodes(edges), [], ["node"], "id")


def indexed_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with node ids instead of keys."""
    a = ids.select(F.col("node").alias("src"), F.col("id").alias("s"))
    b = ids.select(F.col("node").alias("dst"), F.col("id").alias("d"))
    return edges.join(a, "src").join(b, "dst").select("source_row_id", "s", "d")


def mean_messages(messages: DataFrame, features: list[str]) -> DataFrame:
    """Per target node the degree and the mean of the edge features: partially aggregated before the shuffle, so hubs do no harm."""
    return messages.groupBy(F.col("dst").alias("node")).agg(n_rows().alias("degree"), *[F.avg(f).alias(f) for f in features])


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(n_rows().alias("degree"))


def degree_stats(edges: DataFrame) -> DataFrame:
    """Node count, extremes, median and 95th percentile of the degree, and the share of nodes of degree one."""
    d = degrees(edges)
    return d.agg(n_rows().alias("nodes"), F.min("degree").alias("least"), F.percentile("degree", 0.5).alias("median"), F.percentile("degree", 0.95).alias("p95"), F.max("degree").alias("most"), F.round(F.avg((F.col("degree") == 1).cast("int")), 9).alias("share_one"))


def pair_classes(edges: DataFrame, attack: str) -> DataFrame:
    """(pairs, multi, conflicting, ceiling): endpoint pairs, those with several flows or classes, and the best accuracy an endpoint-only rule could have."""
    by_class = edges.groupBy("src", "dst", attack).agg(n_rows().alias("n"))
    pairs = by_class.groupBy("src", "dst").agg(F.sum("n").alias("flows"), F.max("n").alias("top"), n_rows().alias("classes"))
    return pairs.agg(n_rows().alias("pairs"), F.count_if(F.col("flows") > 1).alias("multi"), F.count_if(F.col("classes") > 1).alias("conflicting"), F.round(F.sum("top") / F.sum("flows"), 9).alias("ceiling"))


def unseen_endpoints(held: DataFrame, train: DataFrame) -> DataFrame:
    """(rows, src_unseen, dst_unseen, any_unseen, both_unseen) of held-out edges against train's nodes."""
    known = nodes(train)
    a = known.select(F.col("node").alias("src"), F.lit(1).alias("a"))
    b = known.select(F.col("node").alias("dst"), F.lit(1).alias("b"))
    j = held.join(a, "src", "left").join(b, "dst", "left")
    s, d = F.col("a").isNull(), F.col("b").isNull()
    return j.agg(n_rows().alias("rows"), F.count_if(s).alias("src_unseen"), F.count_if(d).alias("dst_unseen"), F.count_if(s | d).alias("any_unseen"), F.count_if(s & d).alias("both_unseen"))


def sampled_neighbours(messages: DataFrame, seeds: DataFrame, fanout: list[int], seed: int) -> DataFrame:
    """(hop, dst, src, source_row_id, reverse): per hop at most fanout[hop] incoming edges of each frontier node, without replacement.

    Chosen by a seeded hash of the edge and hop, ties by the row id. A hub's edges are cut to the fanout on each
    partition before the shuffle. seeds: a frame with the column node.
    """
    out, frontier = [], seeds.select("node").distinct()
    for hop, k in enumerate(fanout):
        h = digest(F.concat_ws("|", F.col("source_row_id").cast("string"), F.col("reverse").cast("string")), f"{seed}|{hop}")
        w = Window.partitionBy("dst").orderBy(h, "source_row_id", "reverse")
        into = messages.join(frontier.withColumnRenamed("node", "dst"), "dst", "left_semi")
        got = into.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).select(F.lit(hop).alias("hop"), "dst", "src", "source_row_id", "reverse")
        out.append(got)
        frontier = got.select(F.col("src").alias("node")).distinct()
    return reduce(DataFrame.unionByName, out)


def rewired(flow: DataFrame, seed: int = 20260928) -> DataFrame:
    """flow with the destination tuples permuted within each Dataset and split: row i by id gets the tuple of row i by seeded hash.

    Positions come from two range partitions, so no split is sorted in one task; the marginals stay as they are.
    """
    key = ["Dataset", "split"]
    places = ordinals(flow.select(*key, "source_row_id"), key, ["source_row_id"], "_at")
    pool = ordinals(flow.select(*key, "source_row_id", DST_IP, DST_PORT, hash60(F.col("source_row_id"), seed).alias("_h")), key, ["_h", "source_row_id"], "_at")
    p, q = places.alias("p"), pool.alias("q")
    on = [F.col(f"p.{c}").eqNullSafe(F.col(f"q.{c}")) for c in key]
    new = p.join(q, reduce(lambda a, b: a & b, on, F.col("p._at") == F.col("q._at"))).select("p.source_row_id", F.col(f"q.{DST_IP}").alias("_ip"), F.col(f"q.{DST_PORT}").alias("_port"))
    return flow.join(new, "source_row_id").withColumns({DST_IP: F.col("_ip"), DST_PORT: F.col("_port")}).drop("_ip", "_port")


def rewire_gates(before: DataFrame, after: DataFrame, protected: list[str]) -> DataFrame:
    """One row: equal counts, repeated ids, protected mismatches, marginal difference, changed rows, self-loops before and after."""
    loop = F.col(SRC_IP).eqNullSafe(F.col(DST_IP)) & F.col(SRC_PORT).eqNullSafe(F.col(DST_PORT))
    one = before.agg(n_rows().alias("rows_before"), F.count_if(loop).alias("loops_before"))
    two = after.agg(n_rows().alias("rows_after"), (n_rows() - F.countDistinct("source_row_id")).alias("repeated_ids"), F.count_if(loop).alias("loops_after"))
    a, b = before.alias("a"), after.alias("b")
    both = a.join(b, F.col("a.source_row_id") == F.col("b.source_row_id"))
    pair = lambda cols: any_differs([(F.col(f"a.{c}"), F.col(f"b.{c}")) for c in cols])
    diff = both.agg(F.count_if(pair(protected)).alias("protected_mismatches"), F.count_if(pair([DST_IP, DST_PORT])).alias("changed"))
    marginal = multiset_difference(before.select("Dataset", "split", DST_IP, DST_PORT), after.select("Dataset", "split", DST_IP, DST_PORT)).agg(n_rows().alias("marginal_difference"))
    return beside(one, two, diff, marginal)
