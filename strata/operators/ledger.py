"""A metering ledger whose totals are kept, not recounted.

Entries are kept by event in partitions by day, totals by (tenant, meter) in buckets. A
batch looks up the entries of its own events, in the days it names, works out by how
much each total moves, and writes the totals of the buckets it touches. An event that
comes again with another quantity, tenant or meter is a correction: what it stood for
is taken off first. One that comes again unchanged moves nothing, and a batch whose key
has been recorded is a no-op.

The totals are written before the entries. A batch that was cut off in between is
finished by recording it again under its key; until then no other batch is taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.errors import FailedPrecondition, InvalidArgument
from strata.operators.matching import join_on
from strata.sources.versioned import VersionedTable, WriteResult

QUANTITY = T.DecimalType(38, 6)
BUCKETS = 64
ENTRY = "day date, event_id bigint, tenant string, meter string, quantity decimal(38,6)"
TOTAL = "bucket int, tenant string, meter string, quantity decimal(38,6), recorded bigint"


def _schema(text: str) -> T.StructType:
    return T.StructType.fromDDL(text)


class Ledger:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.buckets = spark, buckets
        self.entries = VersionedTable(spark, f"{path}/entries", "entries", partition_by=("day",))
        self.sums = VersionedTable(spark, f"{path}/totals", "totals", partition_by=("bucket",))

    def record(self, events: DataFrame, key: str, order_by: str | None = None) -> WriteResult:
        """Record (event_id, ts, tenant, meter, quantity) under ``key``.

        A null quantity takes the event back. Several rows of one event need
        ``order_by``, and the last one counts. A correction carries the time of the
        event it corrects; null events are refused. Returns what the totals' write
        did, ``rows_affected`` being how many of them moved.
        """
        if not key:
            raise InvalidArgument("a batch needs a key")
        self._finish(key)
        rows = events.select(
            F.to_date("ts").alias("day"), F.col("event_id").cast("bigint").alias("event_id"), "tenant", "meter",
            F.col("quantity").cast(QUANTITY).alias("quantity"), *([F.col(order_by).alias("_order")] if order_by else []),
        )
        staged = self.entries.stage(_last(rows) if order_by else rows)
        batch = self.entries.load(staged.folders, staged.schema)
        if not order_by:
            self.entries.refuse_copies(staged, ["day", "event_id"])
        if not batch.where("day IS NULL OR event_id IS NULL").isEmpty():
            raise InvalidArgument("every event has an id and a time")
        done = self.sums.applied(key)
        if not done:
            done = self.sums.merge(self._moved(batch), ["bucket", "tenant", "meter"], key=key)
        self.entries.merge(batch, ["day", "event_id"], key=key)
        return done

    def _finish(self, key: str) -> None:
        head = self.sums.head()
        last = head["idempotency_key"] if head else ""
        if last and last != key and not self.entries.applied(last):
            raise FailedPrecondition(f"batch {last} was cut off: record it again first")

    def _moved(self, batch: DataFrame) -> DataFrame:
        """The new totals of the (tenant, meter) pairs that the batch moves."""
        before = self._known(self.entries, ENTRY, "day", batch)
        known = before.join(batch.select("day", "event_id"), ["day", "event_id"], "left_semi")
        counted = lambda rows, sign: rows.where("quantity IS NOT NULL").select(
            self._bucket(), "tenant", "meter", (F.col("quantity") * sign).cast(QUANTITY).alias("quantity"), F.lit(sign).cast("bigint").alias("recorded")
        )
        moves = counted(batch, 1).unionByName(counted(known, -1)).groupBy("bucket", "tenant", "meter")
        moves = moves.agg(F.sum("quantity").cast(QUANTITY).alias("quantity"), F.sum("recorded").alias("recorded"))
        moves = moves.where("quantity <> 0 OR recorded <> 0")
        sums = self._known(self.sums, TOTAL, "bucket", moves)
        held = sums.withColumnsRenamed({"quantity": "_quantity", "recorded": "_recorded"})
        both = join_on(moves, held, ["bucket", "tenant", "meter"], "left")
        added = lambda c: F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0))
        return both.select("bucket", "tenant", "meter", added("quantity").cast(QUANTITY).alias("quantity"), added("recorded").alias("recorded"))

    def _bucket(self):
        return F.pmod(F.xxhash64("tenant", "meter"), F.lit(self.buckets)).cast("int").alias("bucket")

    def _known(self, table: VersionedTable, schema: str, partition: str, rows: DataFrame) -> DataFrame:
        """What a table holds in the partitions that ``rows`` touch."""
        if not table.exists():
            return self.spark.createDataFrame([], _schema(schema))
        touched = [row[0] for row in rows.select(partition).distinct().collect()]  # days of a batch, or buckets
        return table.read().where(F.col(partition).isin(touched))

    def totals(self) -> DataFrame:
        """(tenant, meter, quantity, recorded) of all pairs that have events."""
        held = self.sums.read() if self.sums.exists() else self.spark.createDataFrame([], _schema(TOTAL))
        return held.where("recorded > 0").drop("bucket")

    def recounted(self) -> DataFrame:
        """The same from the entries."""
        held = self.entries.read() if self.entries.exists() else self.spark.createDataFrame([], _schema(ENTRY))
        counted = held.where("quantity IS NOT NULL").groupBy("tenant", "meter")
        return counted.agg(F.sum("quantity").cast(QUANTITY).alias("quantity"), F.count(F.lit(1)).alias("recorded"))


def _last(rows: DataFrame) -> DataFrame:
    """The last row of every event; at equal order the largest."""
    whole = [c for c in rows.columns if c not in ("event_id", "day", "_order")]
    last = rows.groupBy("day", "event_id").agg(F.max(F.struct("_order", *whole)).alias("last"))
    return last.select("day", "event_id", *[F.col("last")[c].alias(c) for c in whole])
