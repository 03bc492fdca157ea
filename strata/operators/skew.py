"""Spreading hot keys over tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 64


def salt(columns: Sequence[str], salts: int = SALTS) -> Column:
    """A number below ``salts`` that depends only on the row, so that a task that
    is run again puts every row where it was."""
    return F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in columns]), F.lit(salts))


def salted_join(
    rows: DataFrame, few: DataFrame, keys: Sequence[str], by: Sequence[str], salts: int = SALTS
) -> DataFrame:
    """Inner join in which every key's rows are cut into ``salts`` slices by the
    columns ``by``; ``few``, small per key, is repeated for each slice."""
    sliced = rows.withColumn("_slice", salt(by, salts))
    slices = F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))
    repeated = few.withColumn("_slice", F.explode(slices))
    return sliced.join(repeated, [*keys, "_slice"]).drop("_slice")
