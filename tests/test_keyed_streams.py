"""Keyed state and the change feed, over files that land between runs of one query."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from strata import workspace
from strata.errors import InvalidArgument
from strata.streaming import keyed
from strata.streaming.feed import ChangeFeed, install, write_changes  # noqa: F401
from strata.streaming.sinks import drain
from tests.conftest import as_set

EVENT = "k string, n long, t timestamp, v long"
COMMAND = "trigger_id string, command string, at_unix_ms long, seq long, time timestamp"


def second(s):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)


def ms(s):
    return 1704067200000 + s * 1000


class Run:
    """A query that is stopped after every landing and goes on from its checkpoint."""

    def __init__(self, spark, schema, make):
        self.spark, self.schema, self.make = spark, schema, make
        self.path, self.out, self.checkpoint = (workspace(spark, name) for name in ("in", "out", "checkpoint"))

    def land(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.path)
        with keyed.keyed_state(self.spark):
            stream = self.make(self.spark.readStream.schema(self.schema).parquet(self.path))
            drain(stream.writeStream.format("parquet").option("path", self.out), self.checkpoint)
        return self.spark.read.parquet(self.out).collect()


def test_events_go_out_in_order_across_restarts(spark):
    draw = random.Random(5)
    events = [(k, n, second(0), n * 10) for k in ("hot", "b", None) for n in range(1, 400 if k == "hot" else 20)]
    draw.shuffle(events)
    run = Run(spark, EVENT, lambda s: keyed.in_order(s, "k", "n"))
    gone = 0
    for part in (events[:200], events[200:201], events[201:] + [("b", 3, second(0), 0), ("hot", None, second(0), 0), ("late", 5, second(0), 0)]):
        found = run.land(part)
        released = [row for row in found if row.outcome == keyed.RELEASED]
        assert len(released) >= gone
        gone = len(released)
    assert sorted(((r.partition_key, r.number, r.position) for r in released), key=repr) == sorted(((k, n, n) for k, n, _, _ in events), key=repr)
    assert all(json.loads(r.event)["v"] == r.number * 10 for r in released)
    late = [(r.partition_key, r.number, r.position) for r in found if r.outcome == keyed.LATE]
    assert sorted(late, key=repr) == sorted([("b", 3, None), ("hot", None, None)], key=repr)


def test_a_key_waits_in_packs(spark, monkeypatch):
    """Thousands of events before the first one, in any order, are as many packs as blocks."""
    monkeypatch.setattr(keyed, "PACKED_ROWS", 1500)
    batches = []
    for found in keyed._packed(iter(spark.range(5000).selectExpr("cast(null as string) partition_key", "shiftright(id, 10) block", "id number", "'{}' event", "id at").toArrow().to_batches(700))):
        batches += [(row["block"], len(row["numbers"]) // 8) for row in found.to_pylist()]
    assert sum(n for _, n in batches) == 5000 and len(batches) < 12
    draw = random.Random(8)
    numbers = list(range(1, 4000)) + [7, 3000, None]
    draw.shuffle(numbers)
    run = Run(spark, EVENT, lambda s: keyed.in_order(s, "k", "n", at="t", patience_ms=10_000))
    first = [n for n in numbers if n not in (1, 2500)]
    assert {r.outcome for r in run.land([("a", n, second(0), 0) for n in first])} == {keyed.LATE}
    run.land([("a", 1, second(1), 0)])
    found = run.land([("z", 1, second(30), 0)])
    a = [r for r in found if r.partition_key == "a"]
    released = sorted((r.number, r.position) for r in a if r.outcome == keyed.RELEASED)
    assert released == [(n, n - (n > 2500)) for n in range(1, 4000) if n != 2500]
    assert [(r.number, r.event) for r in a if r.outcome == keyed.SKIPPED] == [(2500, "1")]
    assert sorted((r.number for r in a if r.outcome == keyed.LATE), key=repr) == [3000, 7, None]
    assert all(json.loads(r.event).get("n") == r.number for r in a if r.outcome != keyed.SKIPPED)


def test_micro_batches_of_several_files(spark):
    from suite.streams import in_batches

    rows = spark.range(100).select("id", F.when(F.col("id") < 90, F.col("id") % 2).otherwise(2).cast("int").alias("batch")).where("id <= 90")
    seen, stream = [], in_batches(spark, rows, 3, 10)
    drain(stream.writeStream.foreachBatch(lambda found, _: seen.append(sorted(r.id for r in found.collect()))), workspace(spark, "checkpoint"))
    assert seen == [list(range(0, 90, 2)), list(range(1, 90, 2)), [90]]


def test_patience_ends_a_wait(spark):
    run = Run(spark, EVENT, lambda s: keyed.in_order(s, "k", "n", at="t", patience_ms=10_000))
    run.land([("a", 1, second(0), 0), ("a", 4, second(1), 0), ("a", 5, second(8), 0), ("a", 7, second(9), 0)])
    seen = {(r.number, r.outcome, r.position) for r in run.land([("z", 1, second(12), 0)]) if r.partition_key == "a"}
    assert seen == {(1, "released", 1), (2, "skipped", None), (4, "released", 2), (5, "released", 3)}
    seen = {(r.number, r.outcome, r.position) for r in run.land([("a", 2, second(12), 0), ("a", 6, second(0), 0)]) if r.partition_key == "a"}
    assert seen >= {(2, "late", None), (6, "released", 4), (7, "released", 5)}
    with pytest.raises(InvalidArgument):
        keyed.in_order(spark.createDataFrame([], EVENT), "k", "n", patience_ms=1)


def test_triggers_fire_once_when_due(spark):
    run = Run(spark, COMMAND, keyed.fire)
    first = [("a", "schedule", ms(5), 1), ("b", "schedule", ms(5), 2), ("c", "schedule", ms(50), 3), ("d", "schedule", 0, 4), ("e", "schedule", None, 5)]
    assert run.land([(*row, second(0)) for row in [*first, ("f", "cancel", None, 6), ("g", "schedule", ms(5), 9), ("g", "cancel", None, 8)]]) == []
    fired = run.land([("b", "cancel", None, 10, second(1)), ("past", "schedule", ms(-5), 11, second(1)), (None, "schedule", ms(1), 12, second(1))])
    assert {row.delivery_id for row in fired} == {"past#1"}
    fired = run.land([("clock", "clock", None, 0, second(10))])
    assert sorted((r.delivery_id, r.at_unix_ms, r.fired_at_unix_ms) for r in fired if r.trigger_id in "ag") == [
        ("a#1", ms(5), ms(10)), ("g#1", ms(5), ms(10)),
    ]
    # set again after it fired; a late command of a lower number does not count
    run.land([("a", "schedule", ms(20), 20, second(11)), ("c", "cancel", None, 1, second(11))])
    fired = run.land([("clock", "clock", None, 0, second(60))])
    assert sorted(r.delivery_id for r in fired) == ["a#1", "a#2", "c#1", "g#1", "past#1"]


def test_triggers_of_a_time_fire_once_the_clock_reads_it(spark):
    run = Run(spark, COMMAND, keyed.fire)
    run.land([("a", "schedule", ms(10), 1, second(0)), ("b", "schedule", ms(10) + 1, 2, second(0))])
    fired = run.land([("clock", "clock", None, 0, second(10))])
    assert [r.delivery_id for r in fired] == ["a#1"]


def test_triggers_share_buckets(spark):
    """All triggers in two buckets, whose timers move on with what is left of them."""
    run = Run(spark, COMMAND, lambda s: keyed.fire(s, buckets=2))
    made = [(f"t{i}", "schedule", ms(1 + i % 50), i, second(0)) for i in range(500)]
    run.land(made + [("t7", "cancel", None, 1000, second(0)), ("t8", "schedule", ms(200), 1001, second(0))])
    fired = run.land([("clock", "clock", None, 0, second(21))])
    first = {f"t{i}#1" for i in range(500) if i % 50 < 20} - {"t7#1", "t8#1"}
    assert {r.delivery_id for r in fired} >= first and len(fired) == len({r.delivery_id for r in fired})
    fired = run.land([("t9", "schedule", ms(30), 1002, second(22)), ("clock", "clock", None, 0, second(100))])
    assert sorted(r.delivery_id for r in fired) == sorted([f"t{i}#1" for i in range(500) if i not in (7, 8)] + ["t9#2"])
    with keyed.keyed_state(spark):
        stream = keyed.fire(spark.readStream.schema(COMMAND).parquet(run.path), buckets=2)
        query = drain(stream.writeStream.format("noop"), workspace(spark, "checkpoint"))
    assert 0 < query.recentProgress[0]["stateOperators"][0]["numRowsTotal"] < 20


def changes(spark, first, last):
    key = F.concat(F.when(F.col("id") % 2 == 0, "even/").otherwise("odd/"), F.col("id").cast("string"))
    return spark.range(first, last + 1).select(key.alias("key"), (F.col("id") * 7).cast("string").alias("value"), F.col("id").alias("revision"))


@pytest.fixture
def log(spark, folder):
    install(spark)
    return folder


def test_the_feed_goes_on_behind_its_checkpoint_and_waits_for_gaps(spark, log):
    out, checkpoint = workspace(spark, "out"), workspace(spark, "checkpoint")

    def drained():
        stream = spark.readStream.format("change_feed").options(path=log, prefix="odd/", fromRevision="3").load()
        query = drain(stream.writeStream.format("parquet").option("path", out), checkpoint)
        rows = sum(p["numInputRows"] for p in query.recentProgress)
        return rows, sorted(r.revision for r in spark.read.schema("revision long").parquet(out).collect())

    write_changes(changes(spark, 1, 10), log, 4)
    assert drained() == (4, [3, 5, 7, 9])
    write_changes(changes(spark, 16, 20), log, 4)
    assert drained() == (0, [3, 5, 7, 9])  # 11 to 15 are still missing
    write_changes(changes(spark, 11, 15), log, 4)
    assert drained() == (5, [3, 5, 7, 9, 11, 13, 15, 17, 19])


def test_bounds_and_prefix_go_down_into_the_files(spark, log, capsys):
    write_changes(changes(spark, 1, 50), log, 8)
    write_changes(changes(spark, 1, 50), log, 8)  # the same again
    read = lambda **o: spark.read.format("change_feed").options(path=log, **o).load()
    assert as_set(read()) == as_set(changes(spark, 1, 50))
    some = read().where("revision > 6 AND revision <= 30 AND revision >= 7 AND startswith(key, 'odd/1') AND value <> '91'")
    some.explain()
    plan = capsys.readouterr().out
    assert "revision#" in plan and ("> 6" not in plan) and "odd/1" not in plan and "91" in plan
    assert as_set(some, "revision") == [(11,), (15,), (17,), (19,)]
    assert read(prefix="even/").where("startswith(key, 'odd/')").count() == 0
    assert read(fromRevision="49").count() == 2 and read(fromRevision="0").count() == 0


def test_logs_with_gaps_are_refused(spark, log):
    for rows in (changes(spark, 1, 5).where("revision <> 3"), changes(spark, 0, 2), changes(spark, 1, 2).union(changes(spark, 1, 1))):
        with pytest.raises(InvalidArgument):
            write_changes(rows, log)
    write_changes(changes(spark, 2, 1), log)
    assert spark.read.format("change_feed").option("path", log).load().collect() == []
