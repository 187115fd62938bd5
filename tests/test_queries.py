import pytest

import __spark_entry__ as contract
from tests import oracle

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


TABLES = [n for n, query in contract.queries().items() if query.__module__.startswith("millrace.workload")]


def test_every_query_has_its_sql():
    assert set(TABLES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", TABLES)
def test_query_equals_its_sql(spark, con, name):
    assert oracle.compare(contract.queries()[name](spark, FOLDER), con, contract.oracle_sql()[name]) is None


def test_entry(spark):
    assert contract.entry(spark).count() > 0
