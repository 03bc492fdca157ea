"""Keyed state in streams: events put back in the order of their key, and triggers
that fire when their time comes.

State lives in the state store under the query's checkpoint, so a restart goes on where
the last batch ended. It needs the RocksDB store (``keyed_state`` sets it up).
"""

from __future__ import annotations

import contextlib
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from strata.errors import InvalidArgument

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BLOCK_BITS = 10
BLOCK = 1 << BLOCK_BITS
PACKED_ROWS = 200_000
BUCKETS = 1 << 14
RELEASED, LATE, SKIPPED = "released", "late", "skipped"


@contextlib.contextmanager
def keyed_state(spark: SparkSession):
    """Queries started inside keep their state in RocksDB."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


class _Pack:
    """Events in the order of their numbers."""

    def __init__(self, numbers: np.ndarray, ats: np.ndarray, events: list[str]):
        self.numbers, self.ats, self.events = numbers, ats, events

    @classmethod
    def read(cls, numbers: bytes, ats: bytes, events: bytes) -> _Pack:
        # JSON has no line breaks of its own
        return cls(np.frombuffer(bytes(numbers), np.int64), np.frombuffer(bytes(ats), np.int64), zlib.decompress(bytes(events)).decode().split("\n"))

    @classmethod
    def of(cls, row) -> _Pack:
        return cls.read(row.numbers, row.ats, row.events)

    @classmethod
    def joined(cls, packs: list[_Pack]) -> _Pack:
        numbers, ats = (np.concatenate([getattr(p, name) for p in packs]) for name in ("numbers", "ats"))
        order, events = np.argsort(numbers, kind="stable"), [e for p in packs for e in p.events]
        return cls(numbers[order], ats[order], [events[i] for i in order])

    def some(self, which: np.ndarray) -> _Pack:
        return _Pack(self.numbers[which], self.ats[which], [self.events[i] for i in np.flatnonzero(which)])

    def stored(self) -> tuple[bytes, bytes, bytes]:
        return self.numbers.tobytes(), self.ats.tobytes(), zlib.compress("\n".join(self.events).encode(), 1)

    def row(self, key, outcome: str, before: int | None = None) -> Row:
        numbers, _, events = self.stored()
        return Row(partition_key=key[0], outcome=outcome, before=before, numbers=numbers, events=events)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (partition_key, block, number, event, at) as packs, one for each block of
    a key and ``PACKED_ROWS`` rows."""
    waiting, count = [], 0
    for batch in batches:
        waiting.append(batch)
        count += batch.num_rows
        if count >= PACKED_ROWS:
            yield from _packs(pa.Table.from_batches(waiting))
            waiting, count = [], 0
    if count:
        yield from _packs(pa.Table.from_batches(waiting))


def _packs(table: pa.Table) -> Iterator[pa.RecordBatch]:
    keys, blocks, events = (table[name].to_pylist() for name in ("partition_key", "block", "event"))
    numbers, ats = (pc.fill_null(table[name], 0).to_numpy() for name in ("number", "at"))
    places: dict = {}
    for i, (key, block) in enumerate(zip(keys, blocks)):
        places.setdefault((repr(key), block), []).append(i)
    made = []
    for rows in places.values():
        rows = np.array(rows)[np.argsort(numbers[rows], kind="stable")]
        stored = _Pack(numbers[rows], ats[rows], [events[i] for i in rows]).stored()
        made.append((rows[0], blocks[rows[0]], *stored))
    first, *columns = zip(*made)
    types = [pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    arrays = [table["partition_key"].combine_chunks().take(pa.array(first)), *[pa.array(c, t) for c, t in zip(columns, types)]]
    yield pa.RecordBatch.from_arrays(arrays, ["partition_key", "block", "numbers", "ats", "events"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            outcome, before, numbers, events = (batch[name][i].as_py() for name in ("outcome", "before", "numbers", "events"))
            pack = _Pack.read(numbers, b"", events)
            n = len(pack.events)
            # a late event without a number has none here either
            arrays = [
                batch["partition_key"].take(pa.array([i] * n, pa.int64())),
                pa.array(pack.numbers) if len(pack.numbers) else pa.nulls(n, pa.int64()),
                pa.nulls(n, pa.int64()) if before is None else pa.array(np.arange(before + 1, before + 1 + n)),
                pa.array([outcome] * n), pa.array(pack.events),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["partition_key", "number", "position", "outcome", "event"])


class _InOrder(StatefulProcessor):
    """One key's events by their sequence number, in packs of a block of numbers each.
    What came too early waits as a map entry for each pack, so that a key may have any
    number waiting, and which numbers of a block wait is a bitmap."""

    def __init__(self, first: int, patience_ms: int | None):
        self.first, self.patience_ms = first, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.next = handle.getValueState("next", "number long, position long, held long")
        self.blocks = handle.getMapState("blocks", "block long", "taken binary, packs long")
        self.waiting = handle.getMapState("waiting", "block long, pack long", "numbers binary, ats binary, events binary")
        self.alarm = handle.getValueState("alarm", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        number, position, held = self.next.get() if self.next.exists() else (self.first, 0, 0)
        earliest = None
        for row in rows:
            pack = _Pack.of(row)
            if row.block is None:
                yield _Pack(pack.numbers[:0], pack.ats, pack.events).row(key, LATE)
                continue
            taken, packs = self._block(row.block)
            spot = pack.numbers - row.block * BLOCK
            late = (pack.numbers < number) | taken[spot]
            late[1:] |= pack.numbers[1:] == pack.numbers[:-1]
            if late.any():
                yield pack.some(late).row(key, LATE)
                pack, spot = pack.some(~late), spot[~late]
            if not len(spot):
                continue
            taken[spot] = True
            self._wait(row.block, taken, packs, pack)
            held += len(spot)
            earliest = min(int(pack.ats.min()), earliest if earliest is not None else int(pack.ats.min()))
            while held and (ready := self._ready(number)) is not None:
                yield ready.row(key, RELEASED, position)
                gone = len(ready.numbers)
                number, position, held = number + gone, position + gone, held - gone
        self.next.update((number, position, held))
        self._watch(earliest if held else None)

    def _block(self, block: int) -> tuple[np.ndarray, int]:
        """Which of a block's numbers wait, and in how many packs."""
        found = self.blocks.getValue((block,))
        if found is None:
            return np.zeros(BLOCK, bool), 0
        return np.unpackbits(np.frombuffer(bytes(found[0]), np.uint8)).astype(bool), found[1]

    def _wait(self, block: int, taken: np.ndarray, packs: int, pack: _Pack) -> None:
        self.waiting.updateValue((block, packs), pack.stored())
        self.blocks.updateValue((block,), (np.packbits(taken).tobytes(), packs + 1))

    def _forget(self, block: int, packs: int) -> None:
        for n in range(packs):
            self.waiting.removeKey((block, n))
        self.blocks.removeKey((block,))

    def _ready(self, number: int) -> _Pack | None:
        """The events from ``number`` on without a gap, as far as its block goes; they
        wait no longer."""
        block = number // BLOCK
        taken, packs = self._block(block)
        if not taken[number - block * BLOCK]:
            return None
        pack = _Pack.joined([_Pack.read(*self.waiting.getValue((block, n))) for n in range(packs)])
        now = pack.numbers == number + np.arange(len(pack.numbers))
        self._forget(block, packs)
        if not now.all():
            taken[pack.numbers[now] - block * BLOCK] = False
            self._wait(block, taken, 0, pack.some(~now))
        return pack.some(now)

    def _watch(self, earliest: int | None) -> None:
        """Sets the alarm no later than an event of that time may wait; it may go off
        for one that has gone by then."""
        if self.patience_ms is None or earliest is None:
            return
        wanted = earliest + self.patience_ms
        if self.alarm.exists():
            if self.alarm.get()[0] <= wanted:
                return
            self.handle.deleteTimer(self.alarm.get()[0])
        self.handle.registerTimer(wanted)
        self.alarm.update((wanted,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """What waited long enough no longer waits for the numbers before it."""
        self.alarm.clear()
        number, position, held = self.next.get() if self.next.exists() else (self.first, 0, 0)
        now = timerValues.getCurrentWatermarkInMs()
        packs = [_Pack.read(*value) for _, value in self.waiting.iterator()] if held else []
        if not packs:
            return
        pack = _Pack.joined(packs)
        overdue = pack.numbers[pack.ats + self.patience_ms <= now].max(initial=number)
        runs = np.split(np.arange(len(pack.numbers)), np.flatnonzero(np.diff(pack.numbers) != 1) + 1)
        for run in runs:
            start = int(pack.numbers[run[0]])
            if start > max(number, overdue):
                break
            if start > number:
                yield _Pack(np.array([number]), np.array([0]), [str(start - number)]).row(key, SKIPPED)
            yield _Pack(pack.numbers[run], pack.ats[run], [pack.events[i] for i in run]).row(key, RELEASED, position)
            number, position, held = start + len(run), position + len(run), held - len(run)
        # only the block in which the last one was may have others left
        for block in sorted({int(n) // BLOCK for n in pack.numbers[pack.numbers < number]}):
            taken, count = self._block(block)
            left = (pack.numbers >= number) & (pack.numbers // BLOCK == block)
            self._forget(block, count)
            if left.any():
                taken[:] = False
                taken[pack.numbers[left] - block * BLOCK] = True
                self._wait(block, taken, 0, pack.some(left))
        self.next.update((number, position, held))
        self._watch(min((int(at) for at in pack.ats[pack.numbers >= number]), default=None))

    def close(self) -> None:
        pass


def in_order(
    events: DataFrame, key: str, number: str, first: int = 1, at: str | None = None, delay: str = "0 seconds", patience_ms: int | None = None
) -> DataFrame:
    """Give every key's events out by their ``number``, which counts ``first``, first +
    1, ... without gaps, whatever order they come in.

    Returns (partition_key, number, position, outcome, event): ``event`` is the whole
    event as JSON, ``position`` counts what a key has given out. An event that comes
    before the ones in front of it waits in state. One whose number has been given out,
    is already waiting or is null has the outcome ``late`` and no position.

    With ``patience_ms`` an event that has waited so long by the watermark of the time
    ``at`` goes out without the missing ones; a row ``skipped`` says from which number
    on and how many, and they are late if they come after all; an event without a time
    waits for the next move of the clock. Null is a key. Events
    are packed by blocks of ``BLOCK`` numbers in all tasks; the packs of a key are dealt
    with in one task, and what waits is not held in memory, but for the moment patience
    ends.
    """
    if patience_ms is not None and at is None:
        raise InvalidArgument("patience needs a time")
    whole = F.to_json(F.struct(*[F.col(f"`{c}`") for c in events.columns]))
    time = F.col(f"`{at}`") if at else F.lit(None).cast("timestamp")
    timed = events.withWatermark(at, delay) if patience_ms is not None and events.isStreaming else events
    columns = [F.col(f"`{key}`").alias("partition_key"), F.col(f"`{number}`").cast("long").alias("number"), whole.alias("event")]
    # without the column of the watermark, or Spark would drop what is behind it
    rows = timed.select(*columns, F.coalesce(F.unix_millis(time), F.lit(0)).alias("at"))
    kind = f"partition_key {events.schema[key].dataType.simpleString()}"
    blocks = rows.withColumn("block", F.shiftright("number", BLOCK_BITS)).repartition("partition_key", "block")
    packs = blocks.mapInArrow(_packed, f"{kind}, block long, numbers binary, ats binary, events binary")
    schema = f"{kind}, outcome string, before long, numbers binary, events binary"
    mode = "none" if patience_ms is None else "eventTime"
    released = packs.groupBy("partition_key").transformWithState(_InOrder(first, patience_ms), schema, "append", mode)
    return released.mapInArrow(_unpacked, f"{kind}, number long, position long, outcome string, event string")


SCHEDULE, CANCEL, CLOCK = "schedule", "cancel", "clock"


class _Triggers(StatefulProcessor):
    """The state of a bucket of triggers: when each is due, how often it has been set and
    by which command. The bucket has one timer, for the first of them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "triggers string")
        self.alarm = handle.getValueState("alarm", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        # of the commands of a batch only the last one of a trigger counts
        last: dict = {}
        for row in rows:
            if row.trigger_id is None or row.command == CLOCK:
                continue
            rank = (row.seq, row.command == CANCEL, row.at or 0)
            if row.trigger_id not in last or rank > last[row.trigger_id][0]:
                last[row.trigger_id] = (rank, row.at if row.command == SCHEDULE and row.at is not None and row.at > 0 else None)
        if last:
            held = self._read()
            for trigger, ((seq, *_), at) in last.items():
                _, times, seen = held.get(trigger, (None, 0, None))
                if seen is None or seq >= seen:
                    held[trigger] = (at, times + (at is not None), seq)
            self._keep(held)
        yield from ()

    def _read(self) -> dict:
        found = self.held.get()
        return json.loads(found[0]) if found else {}

    def _keep(self, held: dict) -> None:
        self.held.update((json.dumps(held),))
        before, first = self.alarm.get(), min((at for at, _, _ in held.values() if at is not None), default=None)
        if before and before[0] != first:
            self.handle.deleteTimer(before[0])
            self.alarm.clear()
        if first is not None and not (before and before[0] == first):
            self.handle.registerTimer(first)
            self.alarm.update((first,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now, held = timerValues.getCurrentWatermarkInMs(), self._read()
        self.alarm.clear()
        for trigger, (at, times, seq) in held.items():
            if at is not None and at <= now:
                held[trigger] = (None, times, seq)
                yield Row(trigger_id=trigger, at_unix_ms=at, fired_at_unix_ms=now, delivery_id=f"{trigger}#{times}")
        self._keep(held)

    def close(self) -> None:
        pass


def fire(commands: DataFrame, delay: str = "0 seconds", buckets: int = BUCKETS) -> DataFrame:
    """Triggers of (trigger_id, command, at_unix_ms, seq, time) that have come due.

    ``schedule`` sets a trigger to a time, again if it was set before, fired or
    cancelled; ``cancel`` stops one that has not fired, and one that was never set is
    no error. Of a trigger's commands the one of the highest ``seq`` counts. The clock
    is the watermark of ``time``, which rows of the command ``clock`` may move on. A
    trigger set to a time that has passed fires at once; zero, negative times and null
    never come.

    Every setting fires at most once and has a ``delivery_id`` of its own, the same if
    a batch is run again; keep those that a sink has seen. Triggers are dealt to
    ``buckets`` by hash; a batch reads and writes the buckets it has commands for, so
    take more of them where very many triggers are kept and few are set at a time.
    """
    timed = commands.withWatermark("time", delay) if commands.isStreaming else commands
    # without the column of the watermark, or Spark would drop what is behind it
    bucket = F.pmod(F.xxhash64("trigger_id"), F.lit(buckets)).alias("bucket")
    rows = timed.select(bucket, "trigger_id", "command", F.col("at_unix_ms").cast("long").alias("at"), F.col("seq").cast("long").alias("seq"))
    schema = "trigger_id string, at_unix_ms long, fired_at_unix_ms long, delivery_id string"
    return rows.groupBy("bucket").transformWithState(_Triggers(), schema, "append", "eventTime")
