"""The queries this repository answers, each with the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strata.session import query as run_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def registered(name: str, sql: str | None = None):
    """Register a query under ``name``, with SQL over the same tables."""

    def keep(build):
        QUERIES[name] = build
        if sql:
            ORACLES[name] = sql
        return build

    return keep


def sql_query(name: str, sql: str, tables: str, oracle: str | None = None) -> None:
    """Register a query that is SQL on both sides, the same text where the two
    dialects agree."""

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run_sql(spark, sql, {t: load(spark, sf_dir, t) for t in tables.split()})

    registered(name, oracle or sql)(build)
