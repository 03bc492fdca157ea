"""Distinct counts and quantiles that add up: sketches kept as rows.

A day's rows become one sketch for each group, of a fixed size whatever the number of
rows. Days, groups and batches are merged from the sketches alone, so a month's users
or a year's median never read the data again. Building a sketch aggregates in every
task before anything is shuffled.

Distinct counts are HyperLogLog sketches: their standard error is about
1.04 / sqrt(2**DISTINCT_SIZE). Quantiles are KLL sketches: the rank of what they return is off
by at most about 2.3 / QUANTILE_SIZE**0.9 of all rows, in 99 of 100 cases; they draw at random, so
a rerun may return another value within that. Nulls are in neither, NaN not in quantiles.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.errors import InvalidArgument, NotFound
from strata.sources.versioned import VersionedTable, WriteResult

DISTINCT_SIZE = 13  # 2**13 registers, 1.1 %
QUANTILE_SIZE = 800  # 0.6 % of the rows
ROWS = "sketched_rows"


def sketched(rows: DataFrame, keys: Sequence[str], distinct: Mapping[str, Column], quantiles: Mapping[str, Column]) -> DataFrame:
    """A row for each group: how many rows, and a binary sketch under each name."""
    if set(distinct) & set(quantiles):
        raise InvalidArgument("a name is for a distinct count or a quantile")
    number = lambda c: F.when(~F.isnan(c.cast("double")), c.cast("double"))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias(ROWS),
        *[F.hll_sketch_agg(c.cast("string"), DISTINCT_SIZE).alias(n) for n, c in distinct.items()],
        *[F.kll_sketch_agg_double(number(c), QUANTILE_SIZE).alias(n) for n, c in quantiles.items()],
    )


def merged(sketches: DataFrame, keys: Sequence[str], distinct: Sequence[str], quantiles: Sequence[str]) -> DataFrame:
    """The sketches of coarser groups, from finer ones."""
    return sketches.groupBy(*keys).agg(
        F.sum(ROWS).alias(ROWS),
        *[F.hll_union_agg(n).alias(n) for n in distinct],
        *[F.kll_merge_agg_double(n, QUANTILE_SIZE).alias(n) for n in quantiles],
    )


def estimate_distinct(sketch: str) -> Column:
    return F.hll_sketch_estimate(sketch)


def estimate_quantile(sketch: str, share: float) -> Column:
    """The value at a share of the rows; null if there are none."""
    return F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(float(share))))


class SketchTable:
    """Sketches by day and group, in partitions by day."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], distinct: Sequence[str], quantiles: Sequence[str]):
        self.keys, self.distinct, self.quantiles = list(keys), list(distinct), list(quantiles)
        self.table = VersionedTable(spark, path, "sketches", partition_by=("day",))

    def add(self, rows: DataFrame, time: str, key: str) -> WriteResult:
        """Sketch a batch under its key. A batch that comes again adds nothing; one
        of days that are there already adds sketches of its own."""
        columns = lambda names: {n: F.col(f"`{n}`") for n in names}
        dated = rows.withColumn("day", F.to_date(time))
        return self.table.append(sketched(dated, ["day", *self.keys], columns(self.distinct), columns(self.quantiles)), key=key)

    def between(self, first: str, last: str, keys: Sequence[str] = ()) -> DataFrame:
        """Merged sketches of the days from ``first`` to ``last``, by some of the
        keys or the day; only those days are read."""
        if not self.table.exists():
            raise NotFound("no batch has been added")
        held = self.table.read().where(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
        return merged(held, list(keys), self.distinct, self.quantiles)

    def compact(self) -> WriteResult:
        """One sketch for each day and group, where batches left several."""
        return self.table.overwrite(merged(self.table.read(), ["day", *self.keys], self.distinct, self.quantiles))
