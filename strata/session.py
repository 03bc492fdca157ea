"""Session set-up, the shared working folder, and SQL over named tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from strata.errors import FailedPrecondition, InvalidArgument

# Settings every job here relies on. Anything cluster-specific (cores, memory,
# spark.checkpoint.dir) stays with whoever submits the job.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot key even where the step after the join then needs a shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "strata", master: str | None = None, **settings) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in {**DEFAULTS, **settings}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Put the settings above on a session somebody else has built."""
    for name, value in DEFAULTS.items():
        spark.conf.set(name, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can see, as named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: there the driver
    and the executors are one process on one disk.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named:
        named = context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise FailedPrecondition("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="strata-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named.rstrip("/")


def workspace(spark: SparkSession, purpose: str) -> str:
    """A fresh folder path under the shared folder."""
    return f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"


def view_name(identifier: str) -> str:
    return identifier.replace(".", "_").replace("/", "_")


def query(spark: SparkSession, sql: str, tables: Mapping[str, object] | None = None) -> DataFrame:
    """Run SQL with each named table bound as a view.

    A table is a DataFrame or anything with ``read()``. Analysis happens inside
    ``spark.sql``, so the views are gone again when this returns.
    """
    bound = []
    try:
        for identifier, table in (tables or {}).items():
            if not identifier:
                raise InvalidArgument("a table needs a name")
            frame = table if isinstance(table, DataFrame) else table.read()
            name = view_name(identifier)
            frame.createOrReplaceTempView(name)
            bound.append(name)
        return spark.sql(sql)
    except (ParseException, AnalysisException) as problem:
        raise InvalidArgument(str(problem)) from problem
    finally:
        for name in bound:
            spark.catalog.dropTempView(name)


def preview(spark: SparkSession, sql: str, tables=None, limit: int = 0) -> DataFrame:
    """The smaller of the SQL's own LIMIT and ``limit`` rows; 0 or less = all."""
    result = query(spark, sql, tables)
    return result.limit(limit) if limit > 0 else result


def execute(spark: SparkSession, sql: str) -> None:
    """Run a statement for its effect. Spark SQL reports no row count."""
    query(spark, sql)


def create_table(spark: SparkSession, name: str, columns: str) -> int:
    """Create a parquet table; creating one affects no rows."""
    execute(spark, f"CREATE TABLE {name} ({columns}) USING parquet")
    return 0


def insert_into(spark: SparkSession, name: str, rows: DataFrame) -> int:
    """Insert by position and return how many rows went in."""
    if not spark.catalog.tableExists(name):
        raise InvalidArgument(f"unknown table {name}")
    counted = Observation()
    rows.observe(counted, F.count(F.lit(1)).alias("rows")).write.insertInto(name)
    return counted.get.get("rows", 0)
