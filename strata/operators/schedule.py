"""Due triggers, run records and at-least-once event delivery as batch jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.operators.ordered import positions

RUN_RECORD = "tick bigint, status string, snapshot string, error string"


def due_triggers(triggers: DataFrame, cancelled: DataFrame, fired: DataFrame, now_ms: int) -> DataFrame:
    """One-shot triggers whose time has come, neither cancelled nor fired."""
    ready = triggers.where((F.col("at_unix_ms") > 0) & (F.col("at_unix_ms") <= now_ms))
    # distinct shrinks repeated notices of one trigger before they are shuffled
    stopped = cancelled.select("trigger_id").unionByName(fired.select("trigger_id")).distinct()
    due = ready.join(stopped, "trigger_id", "left_anti")
    return due.select("trigger_id", F.lit(now_ms).cast("bigint").alias("fired_at_unix_ms"))


def run_records(log: DataFrame) -> DataFrame:
    """Run records kept as JSON values under run keys, one row per run."""
    parsed = log.select("key", F.col("revision"), F.from_json("value", RUN_RECORD).alias("run"))
    return parsed.select("key", "revision", "run.*")


def deduplicate(deliveries: DataFrame, order: str) -> DataFrame:
    """Keep the earliest delivery of every event_id, collapsing copies before the
    shuffle."""
    others = [c for c in deliveries.columns if c != "event_id"]
    first = deliveries.groupBy("event_id").agg(F.min_by(F.struct(*others), order).alias("first"))
    return first.select("event_id", "first.*").select(*deliveries.columns)


def route(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """One row per event and action subscribed to its (tenant, type). The
    subscription table is broadcast only if its size says so."""
    return events.join(subscriptions.select("tenant", "event_type", "action"), ["tenant", "event_type"])


def in_order(events: DataFrame, order: str) -> DataFrame:
    """Number each partition_key's events by ``order``, a number unique per key."""
    return positions(events, ["partition_key"], order)
