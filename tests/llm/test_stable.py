from flowloom.llm.stable import BUCKETS, FACTOR, SHIFT, chosen_buckets, stable_sample


def ids(df):
    return {r["source_row_id"] for r in df.collect()}


def group(i):
    return f"{i:032x}"


def test_permutation():
    assert len({(b * FACTOR + SHIFT) % BUCKETS for b in range(BUCKETS)}) == BUCKETS
    assert chosen_buckets(0.1) <= chosen_buckets(0.2) and chosen_buckets(-1) == 0 and chosen_buckets(2) == BUCKETS


def test_grows_with_data_and_share(flows):
    first = flows([{"source_row_id": i, "flow_group_id": group(i // 3)} for i in range(600)], extra="key bucket first delivery")
    # Some rows come again, spelled otherwise, without their group, or in another one.
    late = flows([{"source_row_id": i, "flow_group_id": [f"{{{group(i // 3).upper()}}}", None, group(7)][i % 3]} for i in range(0, 600, 5)] + [{"source_row_id": 1000 + i, "flow_group_id": group(i)} for i in range(100)])
    a, b, wider = ids(stable_sample([first], 0.2)), ids(stable_sample([first, late.repartition(5)], 0.2)), ids(stable_sample([first, late], 0.4))
    assert a and a <= b <= wider
    assert a == ids(stable_sample([first.repartition(9)], 0.2))
    assert all((i in a) == (i - i % 3 in a) for i in range(600))
    assert all((1000 + g in b) == (3 * g in b) for g in range(100))


def test_missing_and_empty(flows):
    df = flows([{"source_row_id": None}, {"source_row_id": 5, "flow_group_id": " "}, {"source_row_id": 5, "flow_group_id": None}])
    assert ids(stable_sample([df], 1.0)) == {5}
    assert ids(stable_sample([df], 0.0)) == set() == ids(stable_sample([flows([])], 1.0))
