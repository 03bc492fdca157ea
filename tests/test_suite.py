"""Every registered query against its SQL, and results that must not depend on
how rows are spread over partitions."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from strata import VersionedTable, workspace
from strata.plans import strategies
from suite.check import compare, open_database
from suite.loads import KEY, TRACKED, customers, customers_later
from suite.registry import ORACLES, QUERIES
from tests.conftest import TESTDATA, as_set

SMALL = f"{TESTDATA}/sf0.001"


@pytest.fixture(scope="module")
def database():
    return open_database(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, database, name):
    problem = compare(spark, database, name, SMALL)
    # at this size a few selective queries have no rows on either side
    assert problem in (None, "both sides are empty")


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_every_query_has_sql():
    """The training data operators have tests of their own."""
    assert set(ORACLES) == set(QUERIES) and set(QUERIES) <= set(contract.queries())


@pytest.mark.parametrize("load", ["merge", "delete_insert", "scd2"])
def test_partition_count_does_not_matter(spark, load):
    before, after = customers(spark, SMALL), customers_later(spark, SMALL)
    results = []
    for parts in (1, 7):
        folder = workspace(spark, load)
        old, new = before.repartition(parts), after.repartition(parts)
        if load == "scd2":
            table = strategies.scd2_table(spark, folder)
            for day, rows in (("d1", old), ("d2", new), ("d3", old)):
                strategies.scd2(table, rows, KEY, TRACKED, day)
        else:
            table = VersionedTable(spark, folder)
            table.append(old)
            getattr(table, load)(new, KEY)
        results.append(as_set(table.read()))
    assert results[0] == results[1]


def test_sketches_are_kept_for_flags_not_for_keys(spark):
    """Aggregates that hold a sketch group by the flag alone."""
    found = contract.queries()["sql_approximate"](spark, SMALL)
    plan = found._jdf.queryExecution().executedPlan().toString()
    sketches = [line for line in plan.splitlines() if "Aggregate(" in line and "percentile" in line]
    assert sketches and not any("l_partkey" in line[line.index("keys=[") : line.index("]", line.index("keys=["))] for line in sketches)


def test_filters_and_columns_reach_the_scan(spark, capsys):
    table = VersionedTable(spark, workspace(spark, "pushed"))
    table.append(spark.read.parquet(f"{SMALL}/orders.parquet"))
    table.read(columns=["o_orderkey"], predicate="o_totalprice > 1000").explain()
    plan = capsys.readouterr().out
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan
    assert "GreaterThan(o_totalprice,1000.0)" in plan


def test_history_load_prunes_closed_versions(spark, capsys):
    table = strategies.scd2_table(spark, workspace(spark, "pruned"))
    strategies.scd2(table, customers(spark, SMALL), KEY, TRACKED, "d1")
    table.read(predicate="is_current").explain()
    assert "PartitionFilters: [isnotnull(is_current" in capsys.readouterr().out


def test_quota_keeps_few_rows_before_the_shuffle(spark, capsys):
    from strata.operators.policy import quota_marks

    requests = spark.range(10).select(
        (F.col("id") % 3).alias("tenant"), F.col("id").alias("at"), F.col("id").alias("request_id"), F.lit("QUOTA").alias("kind")
    )
    quota_marks(requests, 2).explain()
    assert capsys.readouterr().out.count("WindowGroupLimit") == 2
