import pytest

from flowloom.operators import validation as V
from flowloom.schema import RAW_COLUMNS, require_columns


@pytest.mark.parametrize(
    ("change", "reason"),
    [
        ({"L4_SRC_PORT": 65536}, "port_invalid"),
        ({"L4_DST_PORT": -1}, "port_invalid"),
        ({"IPV4_SRC_ADDR": "bad"}, "ip_invalid"),
        ({"IPV4_SRC_ADDR": "010.0.0.1"}, "ip_invalid"),
        ({"Label": 1}, "label_invalid"),
        ({"L7_PROTO": float("inf")}, "nonfinite"),
        ({"L7_PROTO": float("nan")}, "nonfinite"),
        ({"Attack": " ", "Label": 1}, "attack_empty"),
        ({"Dataset": "wrong"}, "dataset_invalid"),
        ({"Dataset": None}, "missing|dataset_invalid"),
        ({"IN_BYTES": None}, "missing|nonfinite"),
        ({"L4_SRC_PORT": None}, "missing|nonfinite|port_invalid"),
        ({"Label": None}, "missing|nonfinite|label_invalid"),
        ({"Attack": None, "Label": 1}, "missing|attack_empty"),
        ({}, ""),
    ],
)
def test_reasons(flows, change, reason):
    assert V.tagged(flows([change])).first()["rejection_reasons"] == reason


def test_clean_keeps_large_integers(flows):
    clean, rejected = V.clean_and_rejected(flows([{"IN_BYTES": 2**53 + 1}, {"L4_DST_PORT": 70000}]))
    assert [r["IN_BYTES"] for r in clean.collect()] == [2**53 + 1]
    assert rejected.count() == 1 and "rejection_reasons" not in clean.columns


def test_counts_overlap_and_keep_zeros(flows):
    counts = {r["reason"]: r["n"] for r in V.reason_counts(V.tagged(flows([{"L4_SRC_PORT": None}, {}]))).collect()}
    assert counts == dict.fromkeys(V.REASONS, 0) | {"missing": 1, "nonfinite": 1, "port_invalid": 1}
    assert all(r["n"] == 0 for r in V.reason_counts(V.tagged(flows([]))).collect())


def test_missing_columns_are_named(flows):
    with pytest.raises(ValueError, match="Attack, Label"):
        require_columns(flows([]).drop("Label", "Attack"), RAW_COLUMNS)
