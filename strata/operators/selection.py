"""Picking rows by rank: top k per group and exact order statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.operators.matching import join_on, match_condition
from strata.operators.skew import salt
from strata.session import workspace

# Up to this k Spark limits a ranked group before the shuffle by itself.
GROUP_LIMIT = 1000
# Exact order statistics: most rows ranked in one task, and how finely a range is cut.
RANKED_ROWS = 1_000_000
CUTS = 10_000


def top_per_group(rows: DataFrame, keys: Sequence[str], ordering: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of every group, with their ``rank``.

    Spark applies a small limit before the shuffle too, so a hot group sends k
    rows per task. Beyond that, groups are cut into slices whose first k rows
    compete for the group's.
    """
    ranked = rows
    if k > GROUP_LIMIT:
        sliced = rows.withColumn("_slice", salt(rows.columns))
        window = Window.partitionBy(*keys, "_slice").orderBy(*ordering)
        ranked = sliced.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)
        ranked = ranked.select(*rows.columns)
    window = Window.partitionBy(*keys).orderBy(*ordering)
    return ranked.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def exact_positions(
    rows: DataFrame,
    keys: Sequence[str],
    value: str,
    wanted: Mapping[str, tuple[int, int]],
    ranked_rows: int = RANKED_ROWS,
) -> DataFrame:
    """Per group: row count, mean and, for each ``name: (a, b)``, the value at
    0-based position ``n * a div b`` of the sorted values.

    No group is sorted as a whole. The range a position lies in starts as the
    group's (min, max) and is cut into equal parts, of which counting finds the
    right one, until it holds at most ``ranked_rows`` rows or a single value.
    Only those rows are ranked. A pass is an aggregation; what is known of the
    ranges is a small table, kept between passes. Infinities and NaN (the largest
    value, as everywhere in Spark) are parts of their own, and the smallest and
    the largest number of a range are in different parts, so every pass narrows it.
    Without ``keys`` all rows are one group; without rows there is no group.
    """
    spark = rows.sparkSession
    folder = workspace(spark, "positions")
    present = rows.select(*keys, F.col(value).alias("_value")).where(F.col("_value").isNotNull())
    groups = present.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("_value").alias("mean"), F.min("_value").alias("low"), F.max("_value").alias("high")
    ).where("n > 0")
    targets = F.array(
        *[F.struct(F.lit(name).alias("name"), F.expr(f"n * {a} div {b}").alias("target")) for name, (a, b) in wanted.items()]
    )
    ranges = groups.select(*keys, "n", "mean", "low", "high", F.col("n").alias("inside"), F.explode(targets).alias("at"))
    ranges = ranges.select(*keys, "n", "mean", "low", "high", "inside", "at.*")
    passes = 0
    while True:
        ranges.write.parquet(f"{folder}/{passes}")
        ranges = spark.read.parquet(f"{folder}/{passes}")
        if ranges.where((F.col("inside") > ranked_rows) & (F.col("low") < F.col("high"))).isEmpty():
            break
        ranges = _narrowed(present, ranges, keys)
        passes += 1

    # what lies below a range is counted as one row of value null
    near = _near(present, ranges, keys)
    counted = near.groupBy(*keys, "name", F.when(F.col("_value") >= F.col("low"), F.col("_value")).alias("_value")).agg(
        F.count(F.lit(1)).alias("_rows"), *[F.max(c).alias(c) for c in ("target", "n", "mean")]
    )
    climb = Window.partitionBy(*keys, "name").orderBy(F.col("_value").asc_nulls_first())
    climbed = counted.withColumn("_upto", F.sum("_rows").over(climb)).where(F.col("_upto") > F.col("target"))
    return climbed.groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.max("mean").alias("mean"),
        *[
            F.min(F.when(F.col("name") == name, F.struct("_upto", "_value")))["_value"].alias(name)
            for name in wanted
        ],
    ).where("n IS NOT NULL")


def _near(present: DataFrame, ranges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows up to the upper end of each range of their group."""
    reaches = match_condition("_row", "_range", keys) & (F.col("_row._value") <= F.col("_range.high"))
    joined = present.alias("_row").join(ranges.alias("_range"), reaches)
    others = [c for c in ranges.columns if c not in keys]
    return joined.select("_row.*", *[F.col(f"_range.{c}") for c in others])


def _narrowed(present: DataFrame, ranges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each range cut down to the part that holds its target."""
    near = _near(present, ranges, keys)
    number, low, high = F.col("_value"), F.col("low"), F.col("high")
    if isinstance(present.schema["_value"].dataType, T.FractionalType) and not isinstance(
        present.schema["_value"].dataType, T.DecimalType
    ):
        # halves, so that the width of a range cannot overflow
        finite = F.when(~F.isnan("_value") & (F.abs("_value") < F.lit(float("inf"))), number.cast("double") / 2)
        ends = near.groupBy(*keys, "name").agg(
            F.min(F.when(number >= low, finite)).alias("_least"), F.max(F.when(number >= low, finite)).alias("_most")
        )
        near = join_on(near, ends, [*keys, "name"])
        share = (finite - F.col("_least")) / F.nullif(F.col("_most") - F.col("_least"), F.lit(0.0))
        last = F.when(F.isnan("_value"), F.lit(CUTS + 1)).when(number > 0, F.lit(CUTS)).otherwise(F.lit(-1))
        inside = F.when(finite.isNull(), last).otherwise(F.coalesce(F.least(F.floor(share * CUTS), F.lit(CUTS - 1)), F.lit(0)))
    else:
        exact = T.DecimalType(38, 0) if isinstance(present.schema["_value"].dataType, T.IntegralType) else None
        as_exact = (lambda c: c.cast(exact)) if exact else (lambda c: c)
        share = (as_exact(number) - as_exact(low)).cast("double") / F.nullif(
            (as_exact(high) - as_exact(low)).cast("double"), F.lit(0.0)
        )
        # the largest value has a part of its own, so that a pass always narrows
        inside = F.when(number == high, F.lit(CUTS)).otherwise(
            F.coalesce(F.least(F.floor(share * CUTS), F.lit(CUTS - 1)), F.lit(0))
        )
    # below a range comes before all of its parts
    cut = F.when(number < low, F.lit(-2)).otherwise(inside)
    parts = (
        near.groupBy(*keys, "name", cut.alias("_part"))
        .agg(
            F.count(F.lit(1)).alias("inside"),
            F.min("_value").alias("low"),
            F.max("_value").alias("high"),
            *[F.max(c).alias(c) for c in ("target", "n", "mean")],
        )
    )
    climb = Window.partitionBy(*keys, "name").orderBy("_part")
    holding = parts.withColumn("_upto", F.sum("inside").over(climb)).where(
        (F.col("_upto") > F.col("target")) & (F.col("_upto") - F.col("inside") <= F.col("target"))
    )
    return holding.select(*ranges.columns)
