import math
import random
from collections import Counter

import pytest

from flowloom.llm import overlap
from flowloom.llm.overlap import FIELDS, overlap_classes, overlap_pairs, overlap_report, overlapping_rows

ADDRESS = ("IPV4_SRC_ADDR", "IPV4_DST_ADDR")


def value(r, f):
    v = r.get(f, 1.5 if f in ("L7_PROTO", "SRC_TO_DST_SECOND_BYTES", "DST_TO_SRC_SECOND_BYTES", "FTP_COMMAND_RET_CODE") else {"IPV4_SRC_ADDR": "10.0.0.1", "IPV4_DST_ADDR": "10.0.0.2"}.get(f, 7))
    if isinstance(v, str):
        v = v.strip().lower().removeprefix("::ffff:").removesuffix("/32")
        parts = v.split(".")
        return tuple(map(int, parts)) if len(parts) == 4 and all(p.isdigit() and int(p) < 256 for p in parts) else None
    return v + 0.0 if isinstance(v, float) and not math.isnan(v) else v


def brute(rows):
    side = [{"t": 1, "v": 2}.get((r.get("split") or "")[:1].replace("e", "v")) if r.get("split") != "test" else 2 for r in rows]
    out = set()
    for i, a in enumerate(rows):
        for j, b in enumerate(rows):
            if side[i] == 1 and side[j] == 2:
                same = a.get("flow_group_id") and a["flow_group_id"] == b.get("flow_group_id")
                if same or sum(value(a, f) != value(b, f) for f in FIELDS) <= 3:
                    out.add((min(i, j) + 1, max(i, j) + 1))
    return out


def noisy(n, seed, low):
    r = random.Random(seed)
    rows = []
    for _ in range(n):
        base = dict(r.choice(rows)) if rows and r.random() < 0.7 else {f: r.randrange(low) for f in FIELDS if f not in ADDRESS and f not in ("L7_PROTO", "SRC_TO_DST_SECOND_BYTES", "DST_TO_SRC_SECOND_BYTES", "FTP_COMMAND_RET_CODE")}
        for f in r.sample(FIELDS, r.randrange(6)):
            kind = f in ("L7_PROTO", "SRC_TO_DST_SECOND_BYTES", "DST_TO_SRC_SECOND_BYTES", "FTP_COMMAND_RET_CODE")
            base[f] = r.choice(["10.0.0.7", " 010.0.0.7", "0.0.0.0", None, "::ffff:10.0.0.1"]) if f in ADDRESS else r.choice([None, 0.0, -0.0, 2.5]) if kind else r.choice([None, 0, 5])
        base |= {"split": r.choice(["train", "train", "val", "test", None]), "flow_group_id": r.choice([None, None, None, f"{r.randrange(n // 4):032x}"])}
        rows.append(base)
    return rows


@pytest.mark.parametrize("hot", [250_000, 2])
@pytest.mark.parametrize("low", [2, 1000])
def test_pairs_equal_brute_force(flows, monkeypatch, hot, low):
    monkeypatch.setattr(overlap, "HOT_PAIRS", hot)
    rows = noisy(120, hot + low, low)
    got = [tuple(r) for r in overlap_pairs(flows(rows, extra="k rep side g id v0")).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_shuffled_join_beyond_the_broadcast_bound(flows, monkeypatch):
    monkeypatch.setattr(overlap, "BROADCAST_IDS", -1)
    rows = noisy(60, 4, 3)
    assert {tuple(r) for r in overlap_pairs(flows(rows)).collect()} == brute(rows)


def test_many_exact_copies(flows):
    rows = [{"split": "train"}] * 30 + [{"split": "test"}] * 20
    assert overlap_pairs(flows(rows)).count() == 600


def test_nothing_to_compare(flows):
    assert overlap_pairs(flows([])).count() == 0
    assert overlap_pairs(flows([{"split": "train"}, {"split": None}])).count() == 0


def test_report(flows):
    rows = [{"split": "train"}, {"split": "val", "Attack": " benign"}, {"split": "test", "Attack": "DDoS", **{f: 99 for f in FIELDS[:2] + FIELDS[2:6] if f.startswith(("D", "I", "F", "L4")) and f not in ADDRESS}}, {"split": "test", "Attack": None}]
    got = Counter({(r["split"], r["attack"]): (r["rows"], r["in_train"]) for r in overlap_report(flows(rows)).collect()})
    assert got["val", "benign"] == (1, 1) and got["test", None] == (1, 1) and got["test", "ddos"] == (1, 0)


def test_report_of_noise_equals_brute_force(flows, monkeypatch):
    """The report makes no pairs, yet finds the rows that the pairs name."""
    monkeypatch.setattr(overlap, "HOT_PAIRS", 2)
    rows = noisy(120, 8, 3)
    ends = {i for p in brute(rows) for i in p}
    want = {i for i in ends if rows[i - 1]["split"] in ("val", "test")}
    got = [r["id"] for r in overlapping_rows(flows(rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_report_of_many_copies_is_linear(spark, flows):
    """20 000 train and 20 000 test copies would be 400 million pairs; so would a flow group of as many rows."""
    from pyspark.sql import functions as F

    one = flows([{}]).drop("source_row_id", "split", "flow_group_id", "IN_BYTES")
    copies = one.crossJoin(spark.range(40_000).select((F.col("id") + 1).alias("source_row_id"), F.when(F.col("id") % 2 == 0, "train").otherwise("test").alias("split"), F.lit(None).cast("string").alias("flow_group_id"), F.lit(7).cast("bigint").alias("IN_BYTES")))
    got = overlap_classes(copies)
    assert got.members.count() == 40_000 and got.members.select("rep").distinct().count() == 1 and got.near.count() == 0
    assert [(r["rows"], r["in_train"]) for r in overlap_report(copies).collect()] == [(20_000, 20_000)]
    group = one.drop("IPV4_SRC_ADDR").crossJoin(spark.range(40_000).select((F.col("id") + 1).alias("source_row_id"), F.when(F.col("id") % 2 == 0, "train").otherwise("test").alias("split"), F.lit("a" * 32).alias("flow_group_id"), F.col("id").alias("IN_BYTES"), F.concat(F.lit("10.0."), F.floor(F.col("id") / 200).cast("string"), F.lit("."), (F.col("id") % 200).cast("string")).alias("IPV4_SRC_ADDR")))
    group = group.withColumns({f: F.col("source_row_id") * (i + 3) for i, f in enumerate(("OUT_BYTES", "IN_PKTS", "OUT_PKTS", "MAX_TTL", "L4_SRC_PORT", "MIN_TTL", "DURATION_IN", "DURATION_OUT"))})
    assert [(r["rows"], r["in_train"]) for r in overlap_report(group).collect()] == [(20_000, 20_000)]


def test_missing_is_told_from_its_neighbour(flows):
    """Values that move from one field of a block to another are no copy: three rows of two classes, near as two fields differ."""
    a, b = FIELDS[17], FIELDS[21]
    got = overlap_classes(flows([{"split": "train", a: None, b: 5}, {"split": "test", a: 5, b: None}, {"split": "test", a: None, b: 5}]))
    assert got.members.count() == 2 and got.near.count() == 1
