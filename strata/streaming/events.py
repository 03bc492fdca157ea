"""Streaming twins of the event jobs. Every function takes and returns a
streaming DataFrame (or works on a batch one just the same)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.operators.metering import split_points
from strata.operators.schedule import route


def intake_totals(points: DataFrame) -> DataFrame:
    """Cumulative accepted and rejected points per stream; run in update mode."""
    flag = F.col("accepted").cast("bigint")
    return split_points(points).groupBy("stream").agg(F.sum(flag).alias("accepted"), F.sum(1 - flag).alias("rejected"))


def deduplicate(deliveries: DataFrame, time: str, within: str) -> DataFrame:
    """Drop redeliveries of an event_id that arrive within the delay."""
    return deliveries.withWatermark(time, within).dropDuplicatesWithinWatermark(["event_id"])


def route_events(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Stream-static join of events with their subscriptions."""
    return route(events, subscriptions)


def change_feed(log: DataFrame, prefix: str = "", from_revision: int = 1) -> DataFrame:
    """Log entries under a prefix from a revision on, as they arrive; 0 asks for
    none, as it does of the log itself."""
    if from_revision == 0:
        return log.where(F.lit(False))
    return log.where((F.col("revision") >= from_revision) & F.startswith("key", F.lit(prefix)))


def tumbling_counts(events: DataFrame, time: str, width: str, late: str) -> DataFrame:
    """Events per type and time window, closed once the watermark passes."""
    windowed = events.withWatermark(time, late) if events.isStreaming else events
    return windowed.groupBy(F.window(time, width).alias("window"), "event_type").agg(F.count(F.lit(1)).alias("n"))
