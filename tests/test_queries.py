"""Every registered query against its SQL on the smallest data."""

import pytest

import __spark_entry__ as contract
import oracle

SF_DIR = "/root/testdata/sf0.001"
QUERIES = contract.queries()
ORACLES = contract.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    result = QUERIES[name](spark, SF_DIR)
    if name in ORACLES:
        assert oracle.compare(result, duck, ORACLES[name]) == []
    else:
        assert result.count() > 0


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert {r["session_id"] for r in rows} == {f"s{i}" for i in range(7)}
