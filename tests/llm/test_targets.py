from collections import Counter

from pyspark.sql import functions as F

from flowloom.functions import canon
from flowloom.llm.targets import Target, draw, drawn_by_key, placed_rows, plan_sample, prepared, rake, raked_plans, repair, settle, whole

FIELDS = ("Attack", "Label")


def setup(flows, rows, targets):
    df = prepared(flows(rows, extra="f0 f1 cell bin"), F.col("source_row_id"), canon.split_name("split"), {"Attack": canon.word_key("Attack"), "Label": F.col("Label").cast("string")}, targets)
    quotas, report = plan_sample(df, list(FIELDS), targets)
    return df, quotas, {(r[0], r[4]): r for r in report}


def target(plan, field, category, pct, least=0, split="train", sample=50):
    key = category.lower().replace(" ", "") if field == "Attack" else category
    return Target(plan, split, sample, field, category, pct, least, key)


def test_shares_minimum_and_shortfall(flows):
    rows = [{"Attack": a, "Label": int(a.strip().lower() != "benign")} for a in ["Benign"] * 500 + [" DDoS"] * 300 + ["ddos\t"] * 100 + ["Worms"] * 6 + ["Theft"] * 40] + [{"Attack": None, "Label": None}] * 4
    targets = [target("p", "Attack", "Benign", 50), target("p", "Attack", "DDoS", 45), target("p", "Attack", "Worms", 5, 10), target("p", "Attack", "Theft", 0, 20), target("p", "Attack", "none such", 1, 1)]
    df, quotas, report = setup(flows, rows, targets)
    got = Counter(r["Attack"].strip().lower() for r in draw(df, list(FIELDS), targets, quotas).join(flows(rows), "source_row_id").collect())
    assert {k: (r[9], r[10], r[11]) for k, r in report.items()} == {("p", "Benign"): (500, got["benign"], False), ("p", "DDoS"): (400, got["ddos"], False), ("p", "Worms"): (6, 6, True), ("p", "Theft"): (40, 20, False), ("p", "none such"): (0, 0, True)}
    assert abs(got["benign"] / got["ddos"] - 50 / 45) < 0.15 and sum(got.values()) <= 475


def test_two_margins(flows):
    rows = [{"Attack": a, "Label": b} for a, b, n in (("Benign", 0, 400), ("Benign", 1, 100), ("DDoS", 1, 300), ("DDoS", 0, 200)) for _ in range(n)]
    targets = [target("p", "Attack", "Benign", 60), target("p", "Attack", "DDoS", 40), target("p", "Label", "0", 50), target("p", "Label", "1", 50)]
    df, quotas, report = setup(flows, rows, targets)
    assert {k[1]: r[10] for k, r in report.items()} == {"Benign": 300, "DDoS": 200, "0": 250, "1": 250}
    sample = draw(df, list(FIELDS), targets, quotas)
    assert sample.count() == 500 == sample.select("source_row_id").distinct().count()
    again = draw(df.repartition(9), list(FIELDS), targets, quotas)
    assert {tuple(r) for r in sample.collect()} == {tuple(r) for r in again.collect()}


def test_plans_take_their_split_only(flows):
    rows = [{"split": s, "Attack": "Benign"} for s in ("train", "Training", "test", None) for _ in range(20)]
    targets = [target("a", "Attack", "Benign", 100), target("b", "Attack", "Benign", 100, split="test", sample=100)]
    df, quotas, _ = setup(flows, rows, targets)
    assert Counter(r["plan_id"] for r in draw(df, list(FIELDS), targets, quotas).collect()) == {"a": 20, "b": 20}


def test_empty(flows):
    targets = [target("p", "Attack", "Benign", 100, 1)]
    df, quotas, report = setup(flows, [], targets)
    assert report["p", "Benign"][11] and draw(df, list(FIELDS), targets, quotas).count() == 0
    assert setup(flows, [{}], [])[2] == {}


def test_raking_caps_and_rounding():
    counts = {("a",): 10, ("b",): 1000}
    q = rake(counts, [{"a": 50.0, "b": 50.0}])
    assert abs(q["a",] - 10) < 1e-6 and abs(q["b",] - 50) < 1e-6
    assert sum(whole({("a",): 1.5, ("b",): 1.5}, {("a",): 9, ("b",): 9}, 3).values()) == 3
    assert repair({("a",): 0, ("b",): 50}, counts, [{"a": 4}]) == {("a",): 4, ("b",): 46}


def test_keys_decide_the_draw(flows):
    """Two plans of other weights draw other rows, and each cell's number before any repair is that of the smallest keys of the whole plan."""
    import math

    rows = [{"Attack": a, "Label": 0} for a, n in (("Benign", 300), ("DDoS", 300), ("DoS", 300)) for _ in range(n)]
    targets = [target("a", "Attack", "Benign", 60), target("a", "Attack", "DDoS", 30), target("a", "Attack", "DoS", 10), target("b", "Attack", "Benign", 10), target("b", "Attack", "DDoS", 30), target("b", "Attack", "DoS", 60)]
    df, quotas, report = setup(flows, rows, targets)
    placed = placed_rows(df, list(FIELDS), targets)
    plans = raked_plans(targets, {"train": {("benign", ""): 300, ("ddos", ""): 300, ("dos", ""): 300}}, list(FIELDS))
    counted = drawn_by_key(placed, plans)
    for p in plans:
        keyed = sorted((-math.log1p(-(r["h"] + 0.5) / 2**60) / p.weight((r["cell"].split("|")[1],)), r["id"], r["cell"]) for r in placed.collect() if r["plan_id"] == p.plan)
        want = Counter(c.split("|")[1] for _, _, c in keyed[: p.drawn_size])
        assert {c[0]: n for c, n in counted[p.plan, "train"].items()} == want
        assert all(abs(n - p.expected[c]) < 5 * p.expected[c] ** 0.5 for c, n in counted[p.plan, "train"].items())
    got = draw(df, list(FIELDS), targets, quotas).collect()
    one, two = ({r["source_row_id"] for r in got if r["plan_id"] == p} for p in "ab")
    assert len(one) == len(two) == 450 and one != two
    assert all(r[13] == 0 and r[14] == 450 for r in report.values())


def test_settling_keeps_other_margins():
    counts = {("a", "x"): 50, ("a", "y"): 50, ("b", "x"): 50, ("b", "y"): 50}
    drawn = {("a", "x"): 12, ("a", "y"): 11, ("b", "x"): 8, ("b", "y"): 9}
    out = settle(drawn, counts, [{"a": 20, "b": 20}, {"x": 20, "y": 20}])
    assert sum(out.values()) == 40 and all(out[c] <= counts[c] for c in out)
    assert out["a", "x"] + out["a", "y"] == 20 == out["a", "x"] + out["b", "x"]


def test_repair_of_large_minimums_is_done_at_once():
    counts = {(f"k{i}", l): 10**9 for i in range(30) for l in "01"} | {("rare", "0"): 10**8}
    quota = dict.fromkeys(counts, 10**6) | {("rare", "0"): 0}
    out = repair(quota, counts, [{"rare": 10**7, "k3": 10**6}, {"0": 5}])
    assert out["rare", "0"] == 10**7 and sum(out.values()) == sum(quota.values()) and out["k3", "0"] + out["k3", "1"] >= 10**6


def test_minimum_that_nothing_can_be_taken_for():
    """The sample grows past its size, and says so."""
    assert repair({("a",): 0, ("b",): 5}, {("a",): 9, ("b",): 9}, [{"a": 4, "b": 5}], 5) == {("a",): 4, ("b",): 5}
