"""The registered queries against their SQL."""

import pytest

import __spark_entry__ as contract
from strata.llm.queries import ORACLES, QUERIES
from suite.check import compare, open_database

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, name):
    assert compare(spark, open_database(SMALL), name, SMALL) in (None, "both sides are empty")


def test_all_are_registered():
    numbers = {int(name[2:].split("_")[0]) for name in QUERIES}
    assert numbers == set(range(1, 14))
    assert {*QUERIES, "pipeline"} <= set(contract.queries())
    assert all(contract.oracle_sql()[name] == sql for name, sql in ORACLES.items())
