"""Every registered query against its reference SQL, at the smallest scale."""

import pytest

import __spark_entry__ as contract
from plumbgauge.catalogue import everything
from tests.compare import difference, open_reference

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = everything.queries(), everything.oracle_sql()


@pytest.fixture(scope="module")
def reference():
    return open_reference(FOLDER)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, reference, name):
    problem, _ = difference(QUERIES[name](spark, FOLDER), reference, SQL.get(name))
    assert problem is None, problem


def test_every_query_has_its_sql():
    approximate = {"vector_topk_lsh"}  # its recall is tested in test_scale
    assert set(SQL) == set(QUERIES) - approximate


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert rows and "Unassigned" in rows[-1]["region"]
