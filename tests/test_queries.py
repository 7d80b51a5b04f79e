"""Every core query against its SQL on the smallest tables; queries without SQL must run."""

import pytest

import compare
from flowloom.plans import catalog


@pytest.fixture(scope="module")
def con(small):
    return compare.connect(small)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, con, small, name, monkeypatch):
    monkeypatch.setattr(compare.entry, "queries", lambda: catalog.QUERIES)
    monkeypatch.setattr(compare.entry, "oracle_sql", lambda: catalog.SQL)
    if name in ("m1_perceptron", "m2_sage_training", "m3_random_forest"):
        pytest.skip("see test_models")
    assert not compare.compare(spark, con, small, name).startswith("DIFFER")


def test_names():
    assert set(catalog.SQL) <= set(catalog.QUERIES)
    assert catalog.FLAGSHIP in catalog.QUERIES
