"""Every registered query against its SQL in DuckDB, on whole tables."""

import os

import pytest

import __spark_entry__ as contract
from leasegrain.plans.catalog import QUERIES
from tests.compare import compare, duck

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no benchmark tables here")


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_its_sql(spark, con, name):
    problem = compare(spark, con, FOLDER, name, contract.queries()[name], contract.oracle_sql().get(name))
    assert problem is None or problem == "both empty"


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(contract.queries()) and set(QUERIES) <= set(contract.oracle_sql())


def test_entry_returns_rows(spark):
    assert contract.entry(spark).count() > 0
