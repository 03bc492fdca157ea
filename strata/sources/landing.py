"""Raw inputs: landing CSV files and plain parquet folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strata.errors import InvalidArgument


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV with a header row. Without a schema Spark reads the files twice to
    infer one, so give the schema for anything large."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_parquet(spark: SparkSession, path: str, columns=(), predicate: str | None = None) -> DataFrame:
    """Whole, projected or filtered scan; Catalyst pushes both to the reader."""
    if not path:
        raise InvalidArgument("a table needs a name")
    return scan(spark.read.parquet(path), columns, predicate)


def scan(frame: DataFrame, columns=(), predicate: str | None = None) -> DataFrame:
    if predicate:
        frame = frame.where(predicate)
    return frame.select(*columns) if columns else frame
