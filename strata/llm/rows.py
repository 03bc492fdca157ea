"""Telling rows apart that share an id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.registry import written


def told_apart(documents: DataFrame) -> DataFrame:
    """(doc_id, text, mark): no two rows share an id and a mark. The mark is 0 where an
    id is there once, which leaves those rows where they are. Of rows whose id is null
    or there again each gets a number, and they are written, so that it stays theirs.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    several = written(
        rows.groupBy("doc_id").count().where("doc_id IS NULL OR count > 1").select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("unnamed")),
        "several-ids",
    )
    if several.isEmpty():
        return rows.withColumn("mark", F.lit(0).cast("long"))
    shared = (F.coalesce("doc_id", F.lit(0)) == F.col("id")) & (F.col("doc_id").isNull() == F.col("unnamed"))
    alone = rows.join(several, shared, "left_anti").withColumn("mark", F.lit(0).cast("long"))
    again = rows.join(several, shared, "left_semi").withColumn("mark", F.monotonically_increasing_id() + 1)
    return alone.union(written(again, "numbered"))
