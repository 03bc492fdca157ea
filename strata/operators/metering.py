"""Usage totals, labelled counters, outcome counts, latency and telemetry.

All of them aggregate before they shuffle, so one hot tenant costs one row per
task and group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions.labels import label_pairs
from strata.operators.ordered import running
from strata.operators.selection import exact_positions


def usage_by_meter(events: DataFrame) -> DataFrame:
    """Total quantity and number of events per (tenant, meter)."""
    return events.groupBy("tenant", "meter").agg(
        F.sum("quantity").alias("quantity"), F.count(F.lit(1)).alias("recorded")
    )


def usage_of(totals: DataFrame, tenant: str, meter: str) -> float:
    """One total; a pair never recorded reads 0.0."""
    row = totals.where((F.col("tenant") == tenant) & (F.col("meter") == meter)).first()
    return float(row.quantity) if row else 0.0


def usage_by_dimension(events: DataFrame) -> DataFrame:
    """Total quantity per (tenant, meter, dimension, value) of the map column."""
    exploded = events.select("tenant", "meter", "quantity", F.explode("dimensions").alias("dimension", "dimension_value"))
    return exploded.groupBy("tenant", "meter", "dimension", "dimension_value").agg(
        F.sum("quantity").alias("quantity"), F.count(F.lit(1)).alias("recorded")
    )


def labelled_counters(points: DataFrame) -> DataFrame:
    """Sum of ``delta`` per metric name and label set, whatever the map's order."""
    keyed = points.select("name", label_pairs(F.col("labels")).alias("labels"), "delta")
    return keyed.groupBy("name", "labels").agg(F.sum("delta").alias("value"))


def outcome_counts(calls: DataFrame) -> DataFrame:
    return calls.groupBy("capability", "outcome").agg(F.count(F.lit(1)).alias("calls"))


def latency_summary(samples: DataFrame, keys: Sequence[str], value: str, **options) -> DataFrame:
    """n, mean, p50 and p99, the last two at sorted positions n div 2 and n*99 div 100."""
    return exact_positions(samples, keys, value, {"p50": (1, 2), "p99": (99, 100)}, **options)


def split_points(points: DataFrame) -> DataFrame:
    """Flag points with a non-empty name as accepted."""
    return points.withColumn("accepted", F.coalesce(F.length("name") > 0, F.lit(False)))


def cumulative_intake(points: DataFrame) -> DataFrame:
    """Accepted and rejected points of each stream up to and including each batch.
    Batches are numbered within their stream."""
    flag = F.col("accepted").cast("bigint")
    per_batch = split_points(points).groupBy("stream", "batch").agg(
        F.sum(flag).alias("in"), F.sum(1 - flag).alias("out")
    )
    totals = running(
        per_batch, ["stream"], "batch", {"accepted": ("sum", F.col("in")), "rejected": ("sum", F.col("out"))}
    )
    return totals.select("stream", "batch", "accepted", "rejected")
