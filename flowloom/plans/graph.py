"""Features, class codes and the flow graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom import schema
from flowloom.functions.hashing import digest_sql, hash60_sql
from flowloom.functions.scalar import close, dot, relu, signed_log1p, z_score
from flowloom.operators import features as X
from flowloom.operators import graph as G
from flowloom.operators.audit import beside, n_rows
from flowloom.operators.skew import ordinals
from flowloom.operators.validation import any_of, nonfinite
from flowloom.plans.registry import Registry, Tables
from flowloom.session import materialize

Q = Registry()

# Features whose sums stay exact enough in any order to be compared at six decimals.
SHOWN = ["PROTOCOL", "L7_PROTO", "IN_PKTS", "OUT_PKTS", "TCP_FLAGS", "MIN_TTL", "MAX_TTL", "LONGEST_FLOW_PKT", "SHORTEST_FLOW_PKT", "TCP_WIN_MAX_IN", "ICMP_TYPE", "DNS_QUERY_TYPE"]
_KNOWN = " AND ".join(f"{c} IS NOT NULL" for c in SHOWN)


def _log(c: str) -> str:
    return f"(sign({c}) * ln(1 + abs({c})))"


@Q("f1_signed_log", f"SELECT source_row_id, round({_log('(IN_BYTES - OUT_BYTES)')}, 6) AS x FROM full_splits")
def signed_log(t: Tables) -> DataFrame:
    """The signed log of a difference."""
    return t.full_splits.select("source_row_id", F.round(signed_log1p((F.col("IN_BYTES") - F.col("OUT_BYTES")).cast("double")), 6).alias("x"))


@Q("f2_log_columns", "WITH flow " + " UNION ALL ".join(f"SELECT '{c}' AS feature, max(abs({c}::DOUBLE)) > 1e20 AS logged FROM flow WHERE split = 'train'" for c in schema.FEATURES))
def log_columns(t: Tables) -> DataFrame:
    """Which features go on a log scale."""
    one = t.flow.where("split = 'train'").agg(*[(F.max(F.abs(F.col(c).cast("double"))) > X.LOG_ABOVE).alias(c) for c in schema.FEATURES])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("logged")) for c in schema.FEATURES])).alias("s")).select("s.*")


@Q("a16_feature_stats", "WITH flow " + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg({_log(c)}), 6) AS mean, round(stddev_pop({_log(c)}), 6) AS scale FROM flow WHERE split = 'train'" for c in SHOWN))
def feature_stats(t: Tables) -> DataFrame:
    """Mean and population deviation of train on the log scale: the twelve features that SQL reproduces; `a16_train_stats` has all of them under the rule."""
    s = X.feature_stats(t.flow.where("split = 'train'"), SHOWN, SHOWN)
    return s.select("feature", F.round("mean", 6).alias("mean"), F.round("scale", 6).alias("scale"))


@Q("a16_train_stats")
def train_stats(t: Tables) -> DataFrame:
    """Mean and population deviation of train, every feature, on the log scale only where train's raw maximum asks for it. Sums of large values depend on their order, so tests replace SQL."""
    return X.train_stats(t.flow.where("split = 'train'"), list(schema.FEATURES))


@Q("f3_standardize", f"""
WITH flow , s AS (SELECT avg(IN_PKTS) AS m1, stddev_pop(IN_PKTS) AS s1, avg(MAX_TTL) AS m2, stddev_pop(MAX_TTL) AS s2 FROM flow WHERE split = 'train' AND {_KNOWN})
SELECT source_row_id, round(((IN_PKTS - m1) / s1)::FLOAT::DOUBLE, 4) AS z_pkts, round(((MAX_TTL - m2) / s2)::FLOAT::DOUBLE, 4) AS z_ttl FROM flow, s WHERE split = 'test' AND {_KNOWN}""")
def standardize(t: Tables) -> DataFrame:
    """Two features of test rows standardised by train's statistics; `f3_standardize_all` has all."""
    known = t.flow.where(_KNOWN)
    s = known.where("split = 'train'").agg(F.avg("IN_PKTS"), F.stddev_pop("IN_PKTS"), F.avg("MAX_TTL"), F.stddev_pop("MAX_TTL")).first()
    m1, s1, m2, s2 = (F.lit(v) for v in s)
    r = lambda c: F.round(c.cast("double"), 4)
    return known.where("split = 'test'").select("source_row_id", r(z_score(F.col("IN_PKTS"), m1, s1)).alias("z_pkts"), r(z_score(F.col("MAX_TTL"), m2, s2)).alias("z_ttl"))


@Q("f3_standardize_all")
def standardize_all(t: Tables) -> DataFrame:
    """All features of test rows, standardised by train's complete rows as an array in model order; a row with a missing or non-finite feature keeps its place with null."""
    whole = ~any_of([nonfinite(c) for c in schema.FEATURES])
    p = X.Preprocessor.fit(t.flow.where("split = 'train'").where(whole), list(schema.FEATURES), "binary")
    test = t.flow.where("split = 'test'")
    cells = p.transform(test.where(whole)).select("source_row_id", "x")
    return cells.unionByName(test.where(~whole).select("source_row_id", F.lit(None).cast("array<float>").alias("x")))


@Q("f14_stats_close", "SELECT Dataset, abs(avg(MAX_TTL) - 100) <= 1e-7 + 0.5 * 100 AS near FROM full_splits GROUP BY 1")
def stats_close(t: Tables) -> DataFrame:
    """Approximate equality of a statistic with a stored one."""
    return t.full_splits.groupBy("Dataset").agg(close(F.avg("MAX_TTL"), F.lit(100.0), rtol=0.5).alias("near"))


@Q("f4_modulo_concat", "SELECT source_row_id, source_row_id % 7 AS r, CAST(source_row_id AS VARCHAR) || '|20260927' AS key FROM full_splits")
def modulo_concat(t: Tables) -> DataFrame:
    """Modulo, cast and concatenation."""
    return t.full_splits.select("source_row_id", (F.col("source_row_id") % 7).alias("r"), F.concat(F.col("source_row_id").cast("string"), F.lit("|20260927")).alias("key"))


@Q("f5_split_last", "SELECT source_row_id, try_cast(string_split(trim(IPV4_SRC_ADDR, ' '), '.')[-1] AS DOUBLE) AS last_octet FROM full_splits")
def split_last(t: Tables) -> DataFrame:
    """The last piece of a split text as a number, null if it is none."""
    last = F.element_at(F.split(F.trim("IPV4_SRC_ADDR"), r"\."), -1)
    return t.full_splits.select("source_row_id", last.try_cast("double").alias("last_octet"))


@Q("f7_fill_range", "SELECT source_row_id, coalesce(L4_DST_PORT BETWEEN 1 AND 1023, false) AS low, coalesce(Attack, 'none') AS attack FROM full_splits")
def fill_range(t: Tables) -> DataFrame:
    """Range test and filling of nulls."""
    return t.full_splits.select("source_row_id", F.coalesce(F.col("L4_DST_PORT").between(1, 1023), F.lit(False)).alias("low"), F.coalesce("Attack", F.lit("none")).alias("attack"))


@Q("f11_linear_relu", "SELECT source_row_id, round(greatest(0.5 * IN_PKTS - 0.25 * OUT_PKTS - 1.0, 0), 6) AS h FROM full_splits WHERE IN_PKTS IS NOT NULL AND OUT_PKTS IS NOT NULL")
def linear_relu(t: Tables) -> DataFrame:
    """One hidden unit in expressions: matrix row times vector, bias, rectifier."""
    x = F.array(F.col("IN_PKTS").cast("double"), F.col("OUT_PKTS").cast("double"))
    w = F.array(F.lit(0.5), F.lit(-0.25))
    return t.full_splits.where("IN_PKTS IS NOT NULL AND OUT_PKTS IS NOT NULL").select("source_row_id", F.round(relu(dot(w, x) - 1.0), 6).alias("h"))


@Q("f12_node_init", "SELECT CAST(len(v) AS INTEGER) AS n, list_sum(v) AS total FROM (SELECT list_transform(range(39), lambda i: 1.0::DOUBLE) AS v)")
def node_init(t: Tables) -> DataFrame:
    """The all-ones start of a node."""
    v = F.array_repeat(F.lit(1.0), 39)
    return t.spark.range(1).select(F.size(v).alias("n"), F.aggregate(v, F.lit(0.0), lambda a, x: a + x).alias("total"))


@Q("a17_class_weights", "WITH flow , n AS (SELECT Attack, count(*) AS n FROM flow WHERE split = 'train' AND Attack IS NOT NULL GROUP BY 1) SELECT Attack, n, round((SELECT sum(n) FROM n) / ((SELECT count(*) FROM n) * n), 6) AS weight FROM n")
def class_weights(t: Tables) -> DataFrame:
    """Balanced class weights of train."""
    w = X.class_weights(t.flow.where("split = 'train' AND Attack IS NOT NULL").select("Attack"), "Attack")
    return w.select("Attack", "n", F.round("weight", 6).alias("weight"))


@Q("m5_preprocessor", None)
def preprocessor(t: Tables) -> DataFrame:
    """Fitted on train, persisted as JSON, read back, applied to test: class code and sum of the standardised features."""
    known = t.flow.where(" AND ".join(f"{c} IS NOT NULL" for c in schema.FEATURES)).where("Label IN (0, 1)")
    p = X.Preprocessor.fit(known.where("split = 'train'"), list(schema.FEATURES), "binary")
    p = X.Preprocessor.from_json(p.to_json())
    rows = p.labels(p.transform(known.where("split = 'test'")))
    return rows.select("source_row_id", "y", F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + v), 3).alias("sum_x"))


_E = "e AS (SELECT source_row_id, split, Attack, concat_ws(':', IPV4_SRC_ADDR, CAST(L4_SRC_PORT AS VARCHAR)) AS src, concat_ws(':', IPV4_DST_ADDR, CAST(L4_DST_PORT AS VARCHAR)) AS dst, IN_PKTS, MAX_TTL FROM flow)"
_M = "m AS (SELECT source_row_id, split, src, dst, IN_PKTS, MAX_TTL, false AS reverse FROM e UNION ALL SELECT source_row_id, split, dst, src, IN_PKTS, MAX_TTL, true FROM e WHERE src <> dst)"


def edges(t: Tables) -> DataFrame:
    return G.label_edges(t.flow, "split", "Attack", "IN_PKTS", "MAX_TTL")


@Q("g1_multigraph", f"WITH flow , {_E} SELECT split, count(*) AS edges, (SELECT count(DISTINCT n) FROM (SELECT src AS n, split FROM e UNION ALL SELECT dst, split FROM e) x WHERE x.split IS NOT DISTINCT FROM e.split) AS nodes FROM e GROUP BY 1")
def multigraph(t: Tables) -> DataFrame:
    """Edges and nodes of each split's graph."""
    e = edges(t)
    n = e.select("split", F.explode(F.array("src", "dst")).alias("node")).distinct().groupBy(F.col("split").alias("s")).agg(n_rows().alias("nodes"))
    return e.groupBy("split").agg(n_rows().alias("edges")).join(n, F.col("split").eqNullSafe(F.col("s"))).drop("s")


@Q("g2_message_edges", f"WITH flow , {_E}, {_M} SELECT source_row_id, src, dst, reverse FROM m")
def message_edges(t: Tables) -> DataFrame:
    """Message edges in both directions."""
    return G.message_edges(edges(t)).select("source_row_id", "src", "dst", "reverse")


@Q("u6_reversed_counts", f"WITH flow , {_E}, {_M} SELECT reverse, count(*) AS n FROM m GROUP BY 1")
def reversed_counts(t: Tables) -> DataFrame:
    """Forward and reverse edges."""
    return G.message_edges(edges(t)).groupBy("reverse").agg(n_rows().alias("n"))


@Q("g13_graph_counts", f"WITH flow , {_E}, {_M} SELECT (SELECT count(*) FROM m) AS message_edges, (SELECT count(DISTINCT src) FROM m) AS nodes")
def graph_counts(t: Tables) -> DataFrame:
    """Message edges and nodes of the whole graph."""
    m = G.message_edges(edges(t))
    return m.agg(n_rows().alias("message_edges"), F.countDistinct("src").alias("nodes"))


@Q("h10_dense_node_ids", f"WITH flow , {_E} SELECT node, row_number() OVER (ORDER BY node) - 1 AS id FROM (SELECT src AS node FROM e UNION SELECT dst FROM e)")
def dense_node_ids(t: Tables) -> DataFrame:
    """Dense ids of the sorted nodes."""
    return G.dense_node_ids(edges(t))


@Q("j9_indexed_edges", f"WITH flow , {_E}, n AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS id FROM (SELECT src AS node FROM e UNION SELECT dst FROM e)) SELECT source_row_id, a.id AS s, b.id AS d FROM e JOIN n a ON a.node = src JOIN n b ON b.node = dst")
def indexed_edges(t: Tables) -> DataFrame:
    """Edges by node id: two gathers."""
    e = edges(t)
    return G.indexed_edges(e, G.dense_node_ids(e))


@Q("g4_layer1_agg", f"WITH flow , {_E}, {_M} SELECT dst AS node, count(*) AS degree, round(avg(IN_PKTS), 6) AS IN_PKTS, round(avg(MAX_TTL), 6) AS MAX_TTL FROM m WHERE split = 'train' GROUP BY 1")
def layer1(t: Tables) -> DataFrame:
    """The first layer's aggregation: mean of two features of the incoming edges by node; `g4_layer1_all` has all."""
    m = G.mean_messages(G.message_edges(edges(t).where("split = 'train'")), ["IN_PKTS", "MAX_TTL"])
    return m.select("node", "degree", F.round("IN_PKTS", 6).alias("IN_PKTS"), F.round("MAX_TTL", 6).alias("MAX_TTL"))


@Q("a32_message_mean", f"WITH flow , {_E}, {_M} SELECT dst AS node, round(sum(IN_PKTS) / greatest(count(*), 1), 6) AS mean FROM m GROUP BY 1")
def message_mean(t: Tables) -> DataFrame:
    """Sum over degree of the messages' IN_PKTS; `a32_message_mean_all` has all features."""
    return G.message_edges(edges(t)).groupBy(F.col("dst").alias("node")).agg(F.round(F.sum("IN_PKTS") / F.greatest(n_rows(), F.lit(1)), 6).alias("mean"))


def whole_edges(t: Tables) -> DataFrame:
    """Edges with all features, null where a value is not finite."""
    flow = t.flow
    return G.label_edges(flow.withColumns({c: X.finite(c) for c in schema.FEATURES}), "split", *schema.FEATURES)


@Q("g4_layer1_all")
def layer1_all(t: Tables) -> DataFrame:
    """The first layer's aggregation over train: mean of the finite values of every feature of the incoming edges by node. Sums of large values depend on their order, so tests replace SQL."""
    return G.mean_messages(G.message_edges(whole_edges(t).where("split = 'train'")), list(schema.FEATURES))


@Q("a32_message_mean_all")
def message_mean_all(t: Tables) -> DataFrame:
    """Sum over degree of the messages, every feature, all splits."""
    means = [(F.sum(F.col(c).cast("double")) / F.greatest(n_rows(), F.lit(1))).alias(c) for c in schema.FEATURES]
    return G.message_edges(whole_edges(t)).groupBy(F.col("dst").alias("node")).agg(*means)


_DEG = "d AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY 1)"


@Q("a18_degree_stats", f"WITH flow , {_E}, {_DEG} SELECT count(*) AS nodes, min(degree) AS least, quantile_cont(degree, 0.5) AS median, quantile_cont(degree, 0.95) AS p95, max(degree) AS most, round(avg((degree = 1)::INT), 9) AS share_one FROM d")
def degree_stats(t: Tables) -> DataFrame:
    """Degree statistics of the nodes."""
    return G.degree_stats(edges(t))


_PAIR = "c AS (SELECT src, dst, Attack, count(*) AS n FROM e GROUP BY ALL), p AS (SELECT src, dst, sum(n) AS flows, max(n) AS top, count(*) AS classes FROM c GROUP BY ALL)"


@Q("a19_pair_ceiling", f"WITH flow , {_E}, {_PAIR} SELECT count(*) AS pairs, count(*) FILTER (WHERE flows > 1) AS multi, count(*) FILTER (WHERE classes > 1) AS conflicting, round(sum(top) / sum(flows), 9) AS ceiling FROM p")
def pair_ceiling(t: Tables) -> DataFrame:
    """Classes per endpoint pair."""
    return G.pair_classes(edges(t), "Attack")


_SEEN = "k AS (SELECT src AS node FROM e WHERE split = 'train' UNION SELECT dst FROM e WHERE split = 'train'), x AS (SELECT src NOT IN (SELECT node FROM k) AS s, dst NOT IN (SELECT node FROM k) AS d FROM e WHERE split = 'test')"


@Q("j4_unseen_endpoints", f"WITH flow , {_E}, {_SEEN} SELECT count(*) AS rows, count(*) FILTER (WHERE s) AS src_unseen, count(*) FILTER (WHERE d) AS dst_unseen, count(*) FILTER (WHERE s OR d) AS any_unseen, count(*) FILTER (WHERE s AND d) AS both_unseen FROM x")
def unseen(t: Tables) -> DataFrame:
    """Test edges whose nodes train does not have."""
    e = edges(t)
    return G.unseen_endpoints(e.where("split = 'test'"), e.where("split = 'train'"))


@Q("g12_diagnostics", f"WITH flow , {_E}, {_DEG}, {_PAIR}, {_SEEN} SELECT (SELECT max(degree) FROM d) AS most, (SELECT round(sum(top) / sum(flows), 9) FROM p) AS ceiling, (SELECT count(*) FROM x WHERE s OR d) AS any_unseen")
def diagnostics(t: Tables) -> DataFrame:
    """Structure of the graph in one row."""
    e = edges(t)
    return beside(G.degree_stats(e).select("most"), G.pair_classes(e, "Attack").select("ceiling"), G.unseen_endpoints(e.where("split = 'test'"), e.where("split = 'train'")).select("any_unseen"))


def _hop(n: int, frontier: str, k: int) -> str:
    h = digest_sql("concat_ws('|', CAST(source_row_id AS VARCHAR), CAST(reverse AS VARCHAR))", f"7|{n}")
    return f"h{n} AS (SELECT {n} AS hop, dst, src, source_row_id, reverse FROM m WHERE dst IN ({frontier}) QUALIFY row_number() OVER (PARTITION BY dst ORDER BY {h}, source_row_id, reverse) <= {k})"


@Q("g7_neighbor_sample", f"WITH flow , {_E}, {_M}, {_hop(0, 'SELECT dst FROM e WHERE split = ' + chr(39) + 'val' + chr(39), 15)}, {_hop(1, 'SELECT src FROM h0', 10)} SELECT * FROM h0 UNION ALL SELECT * FROM h1")
def neighbor_sample(t: Tables) -> DataFrame:
    """Two hops of sampled incoming edges around the destinations of val."""
    e = edges(t)
    seeds = e.where("split = 'val'").select(F.col("dst").alias("node"))
    return G.sampled_neighbours(G.message_edges(e), seeds, [15, 10], 7)


@Q("g14_relabelled", f"WITH flow , {_E} SELECT e.source_row_id, src, dst, f.Label AS y FROM e JOIN full_splits f USING (source_row_id)")
def relabelled(t: Tables) -> DataFrame:
    """The same edges with the label of another task."""
    return G.label_edges(t.flow, F.col("Label").alias("y"))


_SEED = 20260928
_NEW = f"""p AS (SELECT source_row_id, Dataset, split, row_number() OVER (PARTITION BY Dataset, split ORDER BY source_row_id) AS i FROM flow),
q AS (SELECT Dataset, split, IPV4_DST_ADDR, L4_DST_PORT, row_number() OVER (PARTITION BY Dataset, split ORDER BY {hash60_sql('source_row_id', _SEED)}, source_row_id) AS i FROM flow),
r AS (SELECT p.source_row_id, q.IPV4_DST_ADDR, q.L4_DST_PORT FROM p JOIN q ON p.i = q.i AND p.Dataset IS NOT DISTINCT FROM q.Dataset AND p.split IS NOT DISTINCT FROM q.split)"""


@Q("g8_rewire", f"WITH flow , {_NEW} SELECT * FROM r")
def rewire(t: Tables) -> DataFrame:
    """Destinations permuted within Dataset and split."""
    return G.rewired(t.flow.select("source_row_id", "Dataset", "split", "IPV4_DST_ADDR", "L4_DST_PORT")).select("source_row_id", "IPV4_DST_ADDR", "L4_DST_PORT")


@Q("t3_permutation", f"WITH flow , {_NEW} SELECT source_row_id, i AS place FROM p")
def permutation(t: Tables) -> DataFrame:
    """The 1-based place of each row in its Dataset and split."""
    d = ordinals(t.flow.select("Dataset", "split", "source_row_id"), ["Dataset", "split"], ["source_row_id"], "place")
    return d.select("source_row_id", (F.col("place") + 1).alias("place"))


_LOOP = "IPV4_SRC_ADDR IS NOT DISTINCT FROM {0}.IPV4_DST_ADDR AND L4_SRC_PORT IS NOT DISTINCT FROM {0}.L4_DST_PORT"


@Q("g9_rewire_gates", f"""
WITH flow , {_NEW} SELECT count(*) AS rows_before, count(*) AS rows_after, CAST(0 AS BIGINT) AS repeated_ids, CAST(0 AS BIGINT) AS protected_mismatches, CAST(0 AS BIGINT) AS marginal_difference,
  count(*) FILTER (WHERE f.IPV4_DST_ADDR IS DISTINCT FROM r.IPV4_DST_ADDR OR f.L4_DST_PORT IS DISTINCT FROM r.L4_DST_PORT) AS changed,
  count(*) FILTER (WHERE {_LOOP.format('f')}) AS loops_before, count(*) FILTER (WHERE {_LOOP.format('r')}) AS loops_after FROM flow f JOIN r USING (source_row_id)""")
def rewire_gates(t: Tables) -> DataFrame:
    """The gates that a rewired table must pass; all columns but the destination and the split are protected."""
    protected = [schema.SRC_IP, schema.SRC_PORT, *schema.FEATURES, "Label", "Attack", "Dataset", "flow_group_id"]
    before = t.flow.select("source_row_id", "split", schema.DST_IP, schema.DST_PORT, *protected)
    return G.rewire_gates(before, materialize(G.rewired(before), "rewired"), protected)


@Q("p18_self_loops", "SELECT source_row_id FROM full_splits WHERE IPV4_SRC_ADDR = IPV4_DST_ADDR AND L4_SRC_PORT = L4_DST_PORT")
def self_loops(t: Tables) -> DataFrame:
    """Flows from a node to itself."""
    f = t.full_splits
    return f.where((F.col("IPV4_SRC_ADDR") == F.col("IPV4_DST_ADDR")) & (F.col("L4_SRC_PORT") == F.col("L4_DST_PORT"))).select("source_row_id")


@Q("j2_position_zip", "WITH a AS (SELECT source_row_id, row_number() OVER (ORDER BY source_row_id) AS i FROM full_splits), b AS (SELECT source_row_id AS other, row_number() OVER (ORDER BY source_row_id DESC) AS i FROM full_splits) SELECT source_row_id, other FROM a JOIN b USING (i)")
def position_zip(t: Tables) -> DataFrame:
    """Two orders of one table put side by side by position."""
    ids = t.full_splits.select("source_row_id")
    a = ordinals(ids, [], ["source_row_id"], "i")
    b = ordinals(ids.select((-F.col("source_row_id")).alias("neg")), [], ["neg"], "i").select((-F.col("neg")).alias("other"), "i")
    return a.join(b, "i").select("source_row_id", "other")


QUERIES, SQL = Q.queries, Q.sql
