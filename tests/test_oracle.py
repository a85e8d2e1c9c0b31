"""Every registered query against its independent SQL."""

import pytest
from compare import compare, duck
from conftest import SMALL

import __spark_entry__ as entry_module
from oracle.sql import ORACLES
from vidmetrics.plans.registry import QUERIES as OWN

QUERIES = {name: query for name, query in entry_module.queries().items() if name in OWN}


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry_has_rows(spark):
    assert entry_module.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(name, spark, con):
    assert compare(QUERIES[name](spark, SMALL), con, ORACLES[name]) is None
