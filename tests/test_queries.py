"""Every registered query against its SQL twin on the smallest tables."""

import os

import pytest

import __spark_entry__ as contract
from tidegrid.catalog import ORACLES, QUERIES
from tools.check_oracles import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    relation = duck.sql(ORACLES[name])
    assert relation.limit(1).fetchall(), "a query without rows shows nothing"
    types = dict(zip(relation.columns, map(str, relation.types)))
    assert compare(QUERIES[name](spark, SF), relation.df(), types) == "ok"


def test_entry(spark):
    assert contract.entry(spark).count() > 0
