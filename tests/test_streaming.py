"""Streaming jobs over files that land between runs."""

import pytest
from pyspark.sql import functions as F

from strata import VersionedTable, workspace
from strata.streaming import events as streaming
from strata.streaming.sinks import append_stream, drain, incremental_stream, merge_stream, once_per_batch
from tests.conftest import as_set

SCHEMA = "event_id bigint, at timestamp, stream string, name string, key string, revision bigint"


class Feed:
    def __init__(self, spark):
        self.spark, self.path, self.checkpoint = spark, workspace(spark, "feed"), workspace(spark, "checkpoint")

    def land(self, rows):
        data = [(i, second, s, n, k, r) for i, second, s, n, k, r in rows]
        frame = self.spark.createDataFrame(data, "event_id bigint, second bigint, stream string, name string, key string, revision bigint")
        frame = frame.select("event_id", F.timestamp_seconds("second").alias("at"), "stream", "name", "key", "revision")
        frame.coalesce(1).write.mode("append").parquet(self.path)

    def stream(self):
        return self.spark.readStream.schema(SCHEMA).parquet(self.path)


@pytest.fixture
def feed(spark):
    return Feed(spark)


def test_cumulative_intake_over_two_batches(spark, feed, folder):
    table = VersionedTable(spark, folder)
    run = lambda: drain(merge_stream(streaming.intake_totals(feed.stream()), "intake", table, ["stream"]), feed.checkpoint)
    feed.land([(1, 1, "s", "cpu.usage", "k", 1), (2, 2, "s", "mem.usage", "k", 2)])
    run()
    assert as_set(table.read(), "stream", "accepted", "rejected") == [("s", 2, 0)]
    feed.land([(3, 3, "s", "disk.usage", "k", 3), (4, 4, "s", "", "k", 4)])
    run()
    assert as_set(table.read(), "stream", "accepted", "rejected") == [("s", 3, 1)]


def test_redelivered_events_are_dropped(spark, feed, folder):
    table = VersionedTable(spark, folder)
    run = lambda: drain(append_stream(streaming.deduplicate(feed.stream(), "at", "1 hour"), "dedup", table), feed.checkpoint)
    feed.land([(1, 10, "s", "a", "k", 1), (1, 11, "s", "a", "k", 1), (2, 12, "s", "b", "k", 2)])
    run()
    feed.land([(2, 13, "s", "b", "k", 2), (3, 14, "s", "c", "k", 3)])
    run()
    assert as_set(table.read(), "event_id") == [(1,), (2,), (3,)]


def test_a_replayed_batch_takes_effect_once(spark, feed, folder):
    table = VersionedTable(spark, folder)
    feed.land([(1, 10, "s", "a", "k", 1)])

    def twice(rows, key):
        assert not table.append(rows, key=key).already_applied
        assert table.append(rows, key=key).already_applied

    drain(once_per_batch(feed.stream(), "replay", twice), feed.checkpoint)
    assert table.read().count() == 1


def test_a_new_checkpoint_loses_nothing(spark, feed, folder):
    """Batches of a new checkpoint are numbered from 0 again, but are not the old ones."""
    table = VersionedTable(spark, folder)
    run = lambda at: drain(incremental_stream(feed.stream(), "load", table, ["event_id"], "revision"), at)
    feed.land([(1, 1, "s", "a", "k", 1)])
    run(feed.checkpoint)
    feed.land([(2, 2, "s", "b", "k", 2), (1, 3, "s", "newer", "k", 3)])
    run(workspace(spark, "new"))
    assert as_set(table.read(), "event_id", "name") == [(1, "newer"), (2, "b")]


def test_the_change_feed_from_now_on_has_no_backlog(spark, feed):
    feed.land([(1, 1, "s", "a", "app/x", 1)])
    assert streaming.change_feed(spark.read.schema(SCHEMA).parquet(feed.path), "app/", 0).count() == 0


def test_marks_of_a_stream_may_come_in_any_order(spark, feed, folder):
    table = VersionedTable(spark, folder)
    run = lambda: drain(incremental_stream(feed.stream(), "load", table, ["event_id"], "revision"), feed.checkpoint)
    feed.land([(1, 1, "s", "a", "k", 10)])
    run()
    feed.land([(2, 2, "s", "b", "k", 9), (3, 2, "s", "c", "k", 10), (4, 2, "s", "d", "k", 11), (5, 2, "s", "e", "k", None)])
    run()
    feed.land([(1, 3, "s", "stale", "k", 9), (1, 3, "s", "none", "k", None), (2, 3, "s", "b2", "k", 9)])
    run()
    assert as_set(table.read(), "event_id", "name") == [(1, "a"), (2, "b2"), (3, "c"), (4, "d"), (5, "e")]


def test_change_feed_and_routing(spark, feed, folder):
    feed.land([(1, 1, "s", "a", "app/x", 1), (2, 2, "s", "b", "sys/y", 2), (3, 3, "t", "a", "app/z", 3)])
    table = VersionedTable(spark, folder)
    drain(append_stream(streaming.change_feed(feed.stream(), "app/", 2), "feed", table), feed.checkpoint)
    assert as_set(table.read(), "key", "revision") == [("app/z", 3)]

    events = feed.stream().select("event_id", F.col("stream").alias("tenant"), F.col("name").alias("event_type"))
    rules = spark.createDataFrame([("s", "a", "run"), ("s", "a", "log"), ("t", "b", "run")], "tenant string, event_type string, action string")
    routed = VersionedTable(spark, workspace(spark, "routed"))
    drain(append_stream(streaming.route_events(events, rules), "routes", routed), workspace(spark, "c"))
    assert as_set(routed.read(), "event_id", "action") == [(1, "log"), (1, "run")]


def test_incremental_load_as_a_stream(spark, feed, folder):
    table = VersionedTable(spark, folder)
    run = lambda: drain(incremental_stream(feed.stream(), "load", table, ["event_id"], "revision"), feed.checkpoint)
    feed.land([(1, 1, "s", "a", "k", 1), (2, 2, "s", "b", "k", 2)])
    run()
    feed.land([(1, 3, "s", "changed", "k", 5), (2, 3, "s", "stale", "k", 1), (3, 3, "s", "c", "k", 6)])
    run()
    assert as_set(table.read(), "event_id", "name") == [(1, "changed"), (2, "b"), (3, "c")]


def test_tumbling_counts(spark, feed, folder):
    feed.land([(1, 1, "s", "a", "k", 1), (2, 59, "s", "a", "k", 2), (3, 61, "s", "a", "k", 3)])
    frame = spark.read.schema(SCHEMA).parquet(feed.path).withColumn("event_type", F.col("name"))
    found = streaming.tumbling_counts(frame, "at", "1 minute", "1 minute")
    assert as_set(found.select(F.unix_timestamp("window.start"), "n")) == [(0, 2), (60, 1)]
    live = feed.stream().withColumn("event_type", F.col("name"))
    closed = streaming.tumbling_counts(live, "at", "1 minute", "0 seconds").select("window.start", "event_type", "n")
    table = VersionedTable(spark, folder)
    drain(append_stream(closed, "windows", table), feed.checkpoint)
    assert table.read().select("n").collect()[0].n == 2
