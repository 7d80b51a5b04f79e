import pytest
from pyspark.sql import functions as F

from flowloom.operators import graph as G


def edges(spark, rows):
    return spark.createDataFrame([(i, a, b, float(i)) for i, (a, b) in enumerate(rows)], "source_row_id bigint, src string, dst string, f double")


def test_reverse_edges_keep_parallels_and_loops_once(spark):
    m = G.message_edges(edges(spark, [("a", "b"), ("a", "b"), ("b", "b")]))
    assert sorted((r["src"], r["dst"]) for r in m.collect()) == [("a", "b"), ("a", "b"), ("b", "a"), ("b", "a"), ("b", "b")]


def test_node_is_address_and_port(flows):
    f = flows([{"L4_SRC_PORT": p} for p in (1, 2, 2, 2)])
    e = G.label_edges(f)
    assert G.nodes(e).count() == 3 and G.message_edges(e).count() == 8


def test_mean_of_incoming(spark):
    got = {r["node"]: (r["degree"], r["f"]) for r in G.mean_messages(edges(spark, [("a", "c"), ("b", "c"), ("c", "a")]), ["f"]).collect()}
    assert got == {"c": (2, 0.5), "a": (1, 2.0)}


def test_degrees_and_pairs(spark):
    e = edges(spark, [("a", "b"), ("a", "b"), ("c", "b")]).withColumn("Attack", F.element_at(F.array(F.lit("x"), F.lit("y"), F.lit("x")), (F.col("source_row_id") + 1).cast("int")))
    s = G.degree_stats(e).first()
    assert (s["nodes"], s["least"], s["median"], s["most"]) == (3, 1, 2.0, 3)
    p = G.pair_classes(e, "Attack").first()
    assert (p["pairs"], p["multi"], p["conflicting"], p["ceiling"]) == (2, 1, 1, round(2 / 3, 9))


def test_sampling_is_bounded_repeatable_and_hashed(spark):
    m = G.message_edges(edges(spark, [(f"n{i}", "hub") for i in range(40)]))
    seeds = spark.createDataFrame([("hub",)], "node string")
    a = sorted(map(tuple, G.sampled_neighbours(m, seeds, [5, 2], 1).collect()))
    b = sorted(map(tuple, G.sampled_neighbours(m.repartition(3), seeds, [5, 2], 1).collect()))
    assert a == b and sum(r[0] == 0 for r in a) == 5
    assert len({r[3] for r in a if r[0] == 0}) == 5


def test_rewiring_keeps_margins(flows):
    before = flows([{"IPV4_DST_ADDR": f"10.0.1.{i}", "split": "train" if i % 2 else "test"} for i in range(40)])
    gates = G.rewire_gates(before, G.rewired(before), ["IPV4_SRC_ADDR", "Label", "Attack", "split"]).first()
    assert gates["rows_before"] == gates["rows_after"] == 40 and gates["changed"] > 0
    assert gates["repeated_ids"] == gates["protected_mismatches"] == gates["marginal_difference"] == 0


@pytest.mark.parametrize("side", ["IPV4_DST_ADDR", "Label"])
def test_gates_see_damage(flows, side):
    before = flows([{"IPV4_DST_ADDR": f"10.0.1.{i}"} for i in range(6)])
    after = before.withColumn(side, F.lit("9.9.9.9") if side != "Label" else F.lit(1).cast("bigint"))
    gates = G.rewire_gates(before, after, ["Label"]).first()
    assert gates["marginal_difference"] + gates["protected_mismatches"] > 0
