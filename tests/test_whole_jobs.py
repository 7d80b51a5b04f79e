"""Queries that cover every column, against brute force."""

import hashlib
import math

import pytest

from flowloom import schema
from flowloom.operators.splitting import PILOT_CAPS, PILOT_SEED
from flowloom.plans import audit, graph, results, splitting


class Stored:
    """Stands in for the tables of a folder."""

    def __init__(self, **tables):
        self.__dict__ |= tables


def finite(v):
    return v is not None and math.isfinite(v)


def test_train_stats(flows):
    rows = [{"SRC_TO_DST_SECOND_BYTES": v, "IN_BYTES": b, "DNS_TTL_ANSWER": None, "split": s} for v, b, s in ((2.2e240, 1, "train"), (-5.0, 4, "train"), (float("nan"), None, "train"), (1e300, 10**9, "test"))]
    got = {r["feature"]: r for r in graph.train_stats(Stored(flow=flows(rows))).collect()}
    assert set(got) == set(schema.FEATURES)
    assert [f for f, r in got.items() if r["logged"]] == ["SRC_TO_DST_SECOND_BYTES"]
    logs = [math.log1p(2.2e240), -math.log1p(5.0)]
    mean = sum(logs) / 2
    r = got["SRC_TO_DST_SECOND_BYTES"]
    assert (r["n"], r["mean"], r["scale"]) == (2, pytest.approx(mean), pytest.approx(math.sqrt(sum((x - mean) ** 2 for x in logs) / 2)))
    assert tuple(got["IN_BYTES"])[1:] == (False, 2, 2.5, 1.5)
    assert tuple(got["OUT_PKTS"])[1:] == (False, 3, 7.0, 1.0)
    assert tuple(got["DNS_TTL_ANSWER"])[1:] == (False, 0, None, None)


def test_train_stats_of_a_table(spark, small):
    flow = graph.Tables(spark, small).flow
    train = flow.where("split = 'train'").toPandas()
    got = {r["feature"]: r for r in graph.train_stats(Stored(flow=flow)).collect()}
    for f in schema.FEATURES:
        x = [float(v) for v in train[f] if finite(v)]
        logged = max(map(abs, x)) > 1e20
        x = [math.copysign(math.log1p(abs(v)), v) for v in x] if logged else x
        mean = math.fsum(x) / len(x)
        scale = math.sqrt(math.fsum((v - mean) ** 2 for v in x) / len(x)) or 1.0
        assert tuple(got[f])[1:3] == (logged, len(x))
        assert tuple(got[f])[3:] == (pytest.approx(mean, rel=1e-9, abs=1e-12), pytest.approx(scale, rel=1e-7))


def test_feature_extremes(flows):
    rows = [{"SRC_TO_DST_SECOND_BYTES": v, "FTP_COMMAND_RET_CODE": None, "IN_BYTES": b} for v, b in ((2.2e240, 2**53 + 1), (float("nan"), None), (float("-inf"), -3), (-1.5, 0))]
    got = audit.feature_extremes(Stored(full_splits=flows(rows))).first().asDict()
    assert len(got) == 3 * len(schema.FEATURES)
    pick = lambda c: tuple(got[f"{k}_{c}"] for k in ("min", "max", "bad"))
    assert pick("SRC_TO_DST_SECOND_BYTES") == (-1.5, 2.2e240, 2)
    assert pick("FTP_COMMAND_RET_CODE") == (None, None, 4)
    assert pick("IN_BYTES") == (-3, 2**53 + 1, 1)
    assert pick("OUT_PKTS") == (7, 7, 0)


def text(v):
    return "\\N" if v is None else str(v)


def test_flow_fingerprint(flows):
    cols = [c for c in schema.RAW_COLUMNS if c not in schema.TARGETS]
    other = lambda c: "10.9.9.9" if c in schema.STRING_COLUMNS else 2.5 if c in schema.DOUBLE_COLUMNS else 8
    rows = [{}, {"Label": 1, "Attack": "DDoS"}, *[{c: v} for c in cols for v in (other(c), None)]]
    df = flows(rows)
    stored = sorted(df.collect(), key=lambda r: r["source_row_id"])
    got = {r["source_row_id"]: r["fingerprint"] for r in splitting.flow_fingerprint(Stored(full_splits=df)).collect()}
    assert got[1] == got[2] and len(set(got.values())) == len(rows) - 1
    assert all(got[r["source_row_id"]] == hashlib.md5("|".join(text(r[c]) for c in cols).encode()).hexdigest() for r in stored)


def test_pilot_sample(spark):
    """Classes larger and smaller than each cap."""
    parts = [(s, a, n) for s, cap in PILOT_CAPS.items() for a, n in (("DDoS", cap + 7), ("Benign", 3))]
    rows = [(s, a, f"{i:x}") for s, a, n in parts for i in range(n)]
    rows = [(i, g, s, a) for i, (s, a, g) in enumerate(rows)]
    flow = spark.createDataFrame(rows, "source_row_id bigint, flow_group_id string, split string, Attack string")
    want = set()
    for s, a, _ in parts:
        own = sorted((hashlib.md5(f"{g}|{i}|{PILOT_SEED}".encode()).hexdigest(), i) for i, g, s2, a2 in rows if (s2, a2) == (s, a))
        want |= {(i, s, a) for _, i in own[: PILOT_CAPS[s]]}
    assert sorted(map(tuple, splitting.pilot_sample(Stored(flow=flow)).collect())) == sorted(want)


PREDICTED = "row_offset bigint, source_row_id bigint, flow_group_id string, y_true int, y_pred int, p_benign double, p_attack double"


def replayed(spark, flows, change=None, **other):
    flow = flows([{"Label": i % 2, "flow_group_id": f"0x{i:032X}", "split": "test"} for i in range(6)])
    rows = [dict(row_offset=i, source_row_id=i + 1, flow_group_id=f"{i:032x}", y_true=i % 2, y_pred=int(i in (1, 2, 3)), p_benign=0.25 if i in (1, 2, 3) else 0.75, p_attack=0.75 if i in (1, 2, 3) else 0.25) for i in range(6)]
    if change is not None:
        rows[change] |= other
    return results.replay_predictions(Stored(flow=flow, predictions=spark.createDataFrame([tuple(r.values()) for r in rows], PREDICTED))).first()


def test_replay_predictions(spark, flows):
    good = replayed(spark, flows)
    assert good["ok"] and good["stored"] == 6 and good["stored_accuracy"] == good["replayed_accuracy"] == pytest.approx(4 / 6, abs=1e-9)


@pytest.mark.parametrize(
    ("other", "gate"),
    [({"y_pred": 0}, "wrong_predictions"), ({"y_true": 0}, "wrong_truth"), ({"source_row_id": 99}, "unknown_ids"), ({"source_row_id": None}, "unknown_ids"), ({"p_attack": None}, "unknown_probabilities"), ({"p_attack": float("nan")}, "unknown_probabilities"), ({"p_attack": 0.9}, "off_sums"), ({"flow_group_id": "x"}, "wrong_groups"), ({"row_offset": 2}, "clashes")],
)
def test_replay_finds(spark, flows, other, gate):
    bad = replayed(spark, flows, 1, **other)
    assert bad[gate] == 1 and not bad["ok"]


def test_entries_equal(spark):
    kind = "dataset string, task string, model string, seed bigint, seconds_fit double, best_epoch bigint, val_macro_f1 double, val_weighted_f1 double, val_accuracy double, test_macro_f1 double, test_weighted_f1 double, test_accuracy double"
    row = lambda task, seed, f1: ("d", task, "m", seed, 1.0, None, 0.5, 0.5, 0.5, f1, 0.5, 0.5)
    stored = spark.createDataFrame([row("a", 11, 0.5), row("a", 23, 0.5), row("b", 11, 0.5), row("b", 23, 0.6)], kind)
    assert results.entries_equal(Stored(runs=stored)).collect() == [("d", 1, 2)]


def test_layer1_and_message_mean(flows):
    rows = [{"L4_SRC_PORT": a, "L4_DST_PORT": b, "IN_BYTES": v, "L7_PROTO": w, "split": s} for a, b, v, w, s in ((1, 2, 10, 1.5, "train"), (3, 2, 20, float("nan"), "train"), (2, 2, None, 4.5, "train"), (1, 2, 99, 9.5, "test"))]
    rows = [r | {"IPV4_DST_ADDR": "10.0.0.1"} for r in rows]
    got = {r["node"]: r for r in graph.layer1_all(Stored(flow=flows(rows))).collect()}
    assert set(schema.FEATURES) <= set(got["10.0.0.1:2"].asDict())
    pick = lambda r: (r["degree"], r["IN_BYTES"], r["L7_PROTO"], r["MAX_TTL"])
    assert pick(got["10.0.0.1:2"]) == (3, 15.0, 3.0, 7.0)
    assert pick(got["10.0.0.1:3"]) == (1, 20.0, None, 7.0)
    mean = {r["node"]: r for r in graph.message_mean_all(Stored(flow=flows(rows))).collect()}
    assert (mean["10.0.0.1:2"]["IN_BYTES"], mean["10.0.0.1:1"]["L7_PROTO"], mean["10.0.0.1:3"]["MAX_TTL"]) == (129 / 4, 5.5, 7.0)


def test_standardize_all(flows):
    rows = [{"IN_BYTES": 1}, {"IN_BYTES": 5}, {"IN_BYTES": 100, "OUT_BYTES": None}, {"IN_BYTES": 7, "split": "test"}, {"L7_PROTO": float("nan"), "split": "test"}]
    got = {r["source_row_id"]: r["x"] for r in graph.standardize_all(Stored(flow=flows(rows))).collect()}
    assert set(got) == {4, 5} and got[5] is None
    assert got[4] == [2.0 if f == "IN_BYTES" else 0.0 for f in schema.FEATURES]
