"""A change log as a source of its own, read from a revision on.

``write_changes`` keeps a log of (key, value, revision) as files named after the
revisions they hold. The source's offset is a revision: a stream goes on behind the
last one its checkpoint has, a batch reads a range. Both skip files by name, and the
revision and the prefix of the key go down into the files.

    install(spark)
    spark.readStream.format("change_feed").option("path", log).option("prefix", "runs/").load()

A stream sees revisions without gaps: writers may finish in any order, and what lies
behind a missing revision waits until that is there. The folder is reached by pyarrow
from executors and the driver, so it is one that they share (a local disk, HDFS, S3).
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    StringStartsWith,
)

from strata.errors import InvalidArgument
from strata.session import workspace

SCHEMA = "key string, value string, revision bigint"
FILE_ROWS = 1_000_000
_NAME = re.compile(r"changes-(\d+)-(\d+)\.parquet$")
_LAST = (1 << 62) - 1


def write_changes(log: DataFrame, folder: str, file_rows: int = FILE_ROWS) -> None:
    """Add revisions that follow each other without a gap, as files of ``file_rows``.

    Every file is written under another name first and then renamed, so that a reader
    sees whole files only. Writing the same revisions again changes nothing.
    """
    spark = log.sparkSession
    rows = log.select("key", "value", F.col("revision").cast("long").alias("revision"))
    ends = rows.agg(F.min("revision"), F.max("revision"), F.count(F.lit(1)), F.count_distinct("revision")).first()
    if not ends[2]:
        return
    if not ends[2] == ends[3] == ends[1] - ends[0] + 1 or ends[0] < 1:
        raise InvalidArgument("revisions are whole numbers from 1 on, without gaps or repeats")
    staged = workspace(spark, "changes")
    block = F.floor((F.col("revision") - ends[0]) / file_rows)
    blocks = -(-ends[2] // file_rows)
    # a range of blocks never lands in two tasks, so a block is one file
    dealt = rows.withColumn("block", block).repartitionByRange(int(blocks), "block").sortWithinPartitions("block", "revision")
    dealt.write.partitionBy("block").parquet(staged)
    files, place = fs.FileSystem.from_uri(folder)
    source, from_place = fs.FileSystem.from_uri(staged)
    files.create_dir(place)
    for found in source.get_file_info(fs.FileSelector(from_place, recursive=True)):
        number = re.search(r"block=(\d+)/part-.*\.parquet$", found.path)
        if number:
            first = ends[0] + int(number[1]) * file_rows
            last = min(first + file_rows - 1, ends[1])
            source.move(found.path, f"{place}/changes-{first:019d}-{last:019d}.parquet")


@dataclass
class Revisions(InputPartition):
    """Revisions first to last, and the files that hold some of them."""

    first: int
    last: int
    files: list[str] = field(default_factory=list)

    def __post_init__(self):
        super().__init__((self.first, self.last))


class _Log:
    def __init__(self, options: dict):
        if not options.get("path"):
            raise InvalidArgument("a change feed needs a path")
        self.path, self.prefix = options["path"], options.get("prefix", "")
        self.first = int(options.get("fromRevision", 1))
        self.rows = int(options.get("revisionsPerPartition", FILE_ROWS))

    def files(self) -> list[tuple[int, int, str]]:
        """(first, last, file), in order; by their names alone."""
        files, place = fs.FileSystem.from_uri(self.path)
        found = [(_NAME.search(f.path), f.path) for f in files.get_file_info(fs.FileSelector(place, allow_not_found=True))]
        return sorted((int(name[1]), int(name[2]), path) for name, path in found if name)

    def end(self) -> int:
        """The last revision before which none is missing."""
        last = 0
        for first, until, _ in self.files():
            if first > last + 1:
                break
            last = max(last, until)
        return last

    def ranges(self, first: int, last: int) -> list[Revisions]:
        found = []
        for begin, end, path in self.files():
            low, high = max(first, begin), min(last, end)
            while low <= high:
                found.append(Revisions(low, min(high, low + self.rows - 1), [path]))
                low += self.rows
        return found

    def read(self, part: Revisions) -> Iterator:
        files, _ = fs.FileSystem.from_uri(self.path)
        revision = pc.field("revision")
        wanted = (revision >= part.first) & (revision <= part.last)
        if self.prefix:
            wanted &= pc.starts_with(pc.field("key"), self.prefix)
        rows = ds.dataset(part.files, filesystem=files, format="parquet")
        for batch in rows.to_batches(columns=["key", "value", "revision"], filter=wanted):
            if batch.num_rows:
                yield batch


class _Batch(DataSourceReader):
    def __init__(self, log: _Log):
        self.log, self.first, self.last = log, log.first, _LAST

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Revisions from and to, and the prefix of the key, are dealt with here."""
        for one in filters:
            column = getattr(one, "attribute", None)
            if column == ("revision",) and isinstance(one, (GreaterThan, GreaterThanOrEqual)):
                self.first = max(self.first, one.value + isinstance(one, GreaterThan))
            elif column == ("revision",) and isinstance(one, (LessThan, LessThanOrEqual)):
                self.last = min(self.last, one.value - isinstance(one, LessThan))
            elif column == ("key",) and isinstance(one, StringStartsWith) and one.value.startswith(self.log.prefix):
                self.log.prefix = one.value
            else:
                yield one

    def partitions(self) -> Sequence[Revisions]:
        # from 0 means from now, so nothing
        return self.log.ranges(self.first, self.last) if self.log.first > 0 else []

    def read(self, partition: Revisions | None) -> Iterator:
        return self.log.read(partition) if partition else iter(())


class _Stream(DataSourceStreamReader):
    def __init__(self, log: _Log):
        self.log = log

    def initialOffset(self) -> dict:
        return {"revision": self.log.first - 1 if self.log.first > 0 else self.log.end()}

    def latestOffset(self) -> dict:
        return {"revision": max(self.log.end(), self.log.first - 1)}

    def partitions(self, start: dict, end: dict) -> Sequence[Revisions]:
        return self.log.ranges(start["revision"] + 1, end["revision"])

    def read(self, partition: Revisions) -> Iterator:
        return self.log.read(partition)


class ChangeFeed(DataSource):
    """Options: ``path``; ``prefix`` of the keys; ``fromRevision``, 0 being from now on;
    ``revisionsPerPartition``."""

    @classmethod
    def name(cls) -> str:
        return "change_feed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(_Log(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(_Log(self.options))


def install(spark: SparkSession) -> None:
    """Make the format known to a session, with filters going down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ChangeFeed)
