"""The queries of this subpackage, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def registered(name: str, sql: str | None = None):
    def keep(build):
        QUERIES[name] = build
        if sql:
            ORACLES[name] = sql
        return build

    return keep


# Shuffle files go as soon as the job that made them ends, instead of when the driver
# happens to collect garbage. Nothing reads them again: what follows reads the table.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(frame: DataFrame, purpose: str) -> DataFrame:
    """Write a frame to the shared folder and read it again: what follows starts
    from files every executor can reach."""
    from strata.session import workspace

    spark, folder = frame.sparkSession, workspace(frame.sparkSession, purpose)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        frame.write.parquet(folder)
    finally:
        spark.conf.set(_CLEANUP, before)
    made = spark.read.schema(frame.schema).parquet(folder)
    made.folder = folder
    return made


def discard(table: DataFrame) -> None:
    """Delete a table that ``written`` returned, once nothing reads it any more."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
