"""Every query of the problems on the smallest tables, against its SQL where there is one."""

import pytest

import compare
from flowloom.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, small, name):
    assert not compare.compare(spark, compare.connect(small), small, name).startswith("DIFFER")


def test_columns(spark, small):
    want = {"p2_found": ["source_row_id", "cluster_addr"], "p3_found": ["plan_id", "split", "category"], "p5_found": ["row_id_a", "row_id_b"], "p6_ids": ["doc_id", "ids"], "p8_found": ["doc_id", "kind"]}
    assert {n: QUERIES[n](spark, small).columns for n in want} == want
    assert set(SQL) <= set(QUERIES)
