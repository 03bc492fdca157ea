"""Versioned tables: a folder of parquet writes plus a log of commits.

    <path>/data/_write=<id>/[<partition>=<value>/]part-*.parquet
    <path>/commits/<branch>/<version>.json

A commit lists the folders that make up the table at that version, so reading an
old version is reading an older commit. Data is staged first and becomes visible
only when its commit file appears; a folder no commit lists is garbage. A table
fed by many small appends should be compacted with ``maintain`` now and then,
since every commit lists all folders.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.errors import FailedPrecondition, InvalidArgument, NotFound
from strata.operators.matching import match_condition
from strata.sources.commits import CommitLog
from strata.sources.landing import scan

DEFAULT_FILE_BYTES = 256 * 1024 * 1024
NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"  # how Spark names the folder of null


@dataclass(frozen=True)
class WriteResult:
    """``rows_affected`` None means unknown, which is not the same as 0."""

    rows_affected: int | None
    snapshot_id: str
    version: int
    already_applied: bool = False


@dataclass(frozen=True)
class Staged:
    """Rows written but not yet visible."""

    folders: tuple[str, ...]
    rows: int
    schema: T.StructType
    measures: dict


class VersionedTable:
    def __init__(
        self,
        spark: SparkSession,
        path: str,
        identifier: str | None = None,
        branch: str = "main",
        partition_by: Sequence[str] = (),
    ):
        if not path or identifier == "":
            raise InvalidArgument("a table needs a name")
        if not branch or "/" in branch:
            raise InvalidArgument("a branch needs a name without a slash")
        self.spark = spark
        self.path = path.rstrip("/")
        self.identifier = identifier or self.path.rsplit("/", 1)[-1]
        self.branch = branch
        self.data = f"{self.path}/data"
        self.log = CommitLog(spark, f"{self.path}/commits/{branch}")
        self._partition_by = tuple(partition_by)

    # -- looking ---------------------------------------------------------

    def head(self) -> dict | None:
        versions = self.log.versions()
        return self.log.read(versions[-1]) if versions else None

    def exists(self) -> bool:
        return bool(self.log.versions())

    def version(self) -> int:
        """The newest version, -1 before the first write."""
        return max(self.log.versions(), default=-1)

    def snapshot_id(self) -> str:
        head = self.head()
        return head["snapshot_id"] if head else ""

    def history(self) -> DataFrame:
        if not self.exists():
            raise NotFound(f"{self.identifier} has no version on {self.branch}")
        return self.log.history()

    def read(self, version: int | None = None, columns=(), predicate: str | None = None) -> DataFrame:
        """The table now or at ``version``. A table never written reads as empty."""
        if version is None:
            commit = self.head()
        elif version in self.log.versions():
            commit = self.log.read(version)
        else:
            raise NotFound(f"{self.identifier} has no version {version} on {self.branch}")
        if commit is None:
            return self.spark.createDataFrame([], T.StructType([]))
        frame = self.load(commit["folders"], T.StructType.fromJson(commit["schema"]))
        return scan(frame, columns, predicate)

    def load(self, folders, schema: T.StructType) -> DataFrame:
        """The rows of some write folders."""
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self._files(folders, schema).select(*[F.col(f"`{name}`") for name in schema.names])

    def _files(self, folders, schema: T.StructType) -> DataFrame:
        return (
            self.spark.read.schema(T.StructType([*schema.fields, T.StructField("_write", T.StringType())]))
            .option("basePath", self.data)
            .parquet(*[f"{self.data}/{folder}" for folder in folders])
        )

    # -- staging and committing --------------------------------------------

    def stage(self, frame: DataFrame, expected_rows: int | None = None, measures: dict | None = None, file_rows: int = 0) -> Staged:
        """Write rows without publishing them, counting them on the way. A file holds
        at most ``file_rows`` rows, 0 being no limit.

        An input that declares its row count and delivers another is refused.
        """
        write_id = f"_write={uuid.uuid4().hex}"
        partition_by = self.partition_by
        missing = [name for name in partition_by if name not in frame.columns]
        if missing:
            raise InvalidArgument(f"partition columns {missing} are not in the rows")
        counted = Observation()
        if partition_by:
            # AQE splits hot partitions and packs small ones
            frame = frame.hint("rebalance", *partition_by)
        metrics = [F.count(F.lit(1)).alias("rows")]
        strings = [name for name in partition_by if frame.schema[name].dataType == T.StringType()]
        metrics += [F.count_if(F.col(f"`{name}`") == "").alias(f"_empty_{i}") for i, name in enumerate(strings)]
        metrics += [column.alias(name) for name, column in (measures or {}).items()]
        hidden = [name for name in frame.columns if name.startswith("_strata_")]
        schema = T.StructType([f for f in frame.schema.fields if f.name not in hidden])
        observed = frame.observe(counted, *metrics).drop(*hidden)
        observed.write.option("maxRecordsPerFile", file_rows).partitionBy(*partition_by).parquet(f"{self.data}/{write_id}")
        seen = counted.get
        rows = seen.get("rows", 0)
        if any(seen.get(f"_empty_{i}") for i in range(len(strings))):
            raise InvalidArgument("an empty string in a partition column would be stored as null")
        delivered = rows if "delivered" not in (measures or {}) else (seen.get("delivered") or 0)
        if expected_rows is not None and delivered != expected_rows:
            raise FailedPrecondition(f"truncated input: {expected_rows} rows declared, {delivered} arrived")
        if not partition_by:
            folders = (write_id,)
        elif rows == 0:
            folders = ()
        else:
            folders = tuple(self._leaf_folders(write_id, schema))
        return Staged(folders, rows, schema, seen)

    def _leaf_folders(self, write_id: str, schema: T.StructType) -> list[str]:
        found = (
            self.spark.read.format("binaryFile")
            .option("recursiveFileLookup", True)
            .option("pathGlobFilter", "*.parquet")
            .load(f"{self.data}/{write_id}")
            .select(F.regexp_extract(F.col("path"), r"/data/(_write=[0-9a-f]{32}.*)/[^/]+$", 1).alias("folder"))
            .distinct()
            .collect()
        )
        return sorted(row.folder for row in found)

    @property
    def partition_by(self) -> tuple[str, ...]:
        head = self.head()
        return tuple(head["partition_by"]) if head else self._partition_by

    def commit(
        self,
        folders: Sequence[str],
        schema: T.StructType,
        mode: str,
        rows_affected: int | None,
        base_version: int,
        key: str = "",
    ) -> WriteResult:
        """Publish a version on top of ``base_version`` (-1 = nothing yet)."""
        version = base_version + 1
        suffix = f"v{version}" if self.branch == "main" else f"{self.branch}.v{version}"
        record = {
            "version": version,
            "snapshot_id": f"{self.identifier}@{suffix}",
            "mode": mode,
            "rows_affected": rows_affected,
            "idempotency_key": key,
            "committed_at_ms": int(time.time() * 1000),
            "partition_by": list(self.partition_by),
            "schema": json.loads(schema.json()),
            "folders": list(folders),
        }
        if not self.log.add(version, record):
            # the same write may have won from elsewhere
            done = self.applied(key)
            if done:
                return done
            raise FailedPrecondition(f"{self.identifier} moved past version {base_version} (concurrent write)")
        return WriteResult(rows_affected, record["snapshot_id"], version)

    def applied(self, key: str) -> WriteResult | None:
        """What an earlier write under this key returned; "" never matches."""
        if not key or not self.exists():
            return None
        row = self.log.history().where(F.col("idempotency_key") == key).orderBy("version").first()
        return row and WriteResult(row.rows_affected, row.snapshot_id, row.version, already_applied=True)

    def begin(self, key: str, expected_version: int | None):
        """Guards in order: replayed key, then the version the caller expects."""
        done = self.applied(key)
        if done:
            return done, None, -1
        head = self.head()
        version = head["version"] if head else -1
        if expected_version is not None and expected_version != version:
            raise FailedPrecondition(
                f"{self.identifier} is at version {version}, not the expected {expected_version}"
            )
        return None, head, version

    # -- write modes -------------------------------------------------------

    def register(self, schema: T.StructType) -> WriteResult:
        """Create the table empty; registering it again returns what is there."""
        head = self.head()
        if head:
            return WriteResult(0, head["snapshot_id"], head["version"], already_applied=True)
        return self.commit((), schema, "register", 0, -1)

    def append(self, rows: DataFrame, key="", expected_rows=None, expected_version=None) -> WriteResult:
        done, head, version = self.begin(key, expected_version)
        if done:
            return done
        if head:
            rows = conform(rows, T.StructType.fromJson(head["schema"]))
        staged = self.stage(rows, expected_rows)
        while True:
            listed = head["folders"] if head else []
            folders = [*listed, *(staged.folders if staged.rows or not head else ())]
            try:
                return self.commit(folders, staged.schema, "append", staged.rows, version, key)
            except FailedPrecondition:
                # appends commute, so a lost race just moves on to the new head
                lost_at = version
                done, head, version = self.begin(key, expected_version)
                if done:
                    return done
                if version == lost_at:
                    raise
                conform(rows, T.StructType.fromJson(head["schema"]))

    def overwrite(self, rows: DataFrame, key="", expected_rows=None, expected_version=None) -> WriteResult:
        """Replace every row; an empty input truncates."""
        done, _, version = self.begin(key, expected_version)
        if done:
            return done
        staged = self.stage(rows, expected_rows)
        return self.commit(staged.folders, staged.schema, "overwrite", staged.rows, version, key)

    def merge(
        self,
        rows: DataFrame,
        keys: Sequence[str],
        order_by=None,
        key="",
        expected_rows=None,
        expected_version=None,
        skip_empty=False,
    ) -> WriteResult:
        """Upsert whole rows on null-safe keys.

        Several rows for one key need ``order_by``, and the last one wins; an
        ordering column the table lacks is used and dropped.
        ``rows_affected`` counts all source rows, those included. Only folders
        that hold a matching key are rewritten, and where the keys have the
        partition columns among them only partitions that rows come in for are
        read. With ``skip_empty`` a source
        without rows adds no version.
        """
        self._need_keys(keys)
        done, head, version = self.begin(key, expected_version)
        if done:
            return done
        ordering = [order_by] if isinstance(order_by, str) else list(order_by or ())
        wanted = T.StructType.fromJson(head["schema"]) if head else None
        if wanted is not None:
            extra = [name for name in ordering if name not in wanted.names]
            rows = conform(rows, wanted, extra)
        if ordering:
            latest = last_per_key(rows, keys, wanted.names if wanted is not None else rows.columns, ordering)
            staged = self.stage(latest, expected_rows, {"delivered": F.sum("_strata_copies")})
            delivered = staged.measures.get("delivered") or 0
        else:
            staged = self.stage(rows, expected_rows)
            self.refuse_copies(staged, keys)
            delivered = staged.rows
        if skip_empty and not delivered:
            return WriteResult(0, head["snapshot_id"] if head else "", version)
        folders = self._replacing(head, staged, keys)
        return self.commit(folders, staged.schema, "merge", delivered, version, key)

    def delete_insert(
        self, rows: DataFrame, keys: Sequence[str], key="", expected_rows=None, expected_version=None
    ) -> WriteResult:
        """Remove target rows whose key is in the batch, then add the batch as
        it is, copies included."""
        self._need_keys(keys)
        done, head, version = self.begin(key, expected_version)
        if done:
            return done
        if head:
            rows = conform(rows, T.StructType.fromJson(head["schema"]))
        staged = self.stage(rows, expected_rows)
        folders = self._replacing(head, staged, keys, repeated=True)
        return self.commit(folders, staged.schema, "delete_insert", staged.rows, version, key)

    def refuse_copies(self, staged: Staged, keys: Sequence[str]) -> None:
        """Several staged rows with one key are an error; only keys are read."""
        copies = self.load(staged.folders, staged.schema).groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))
        if not copies.where("copies > 1").isEmpty():
            raise InvalidArgument(f"several source rows share the key {list(keys)}: make it unique or name an order_by")

    @staticmethod
    def _need_keys(keys):
        if not keys:
            raise InvalidArgument("merge keys are required")

    def _replacing(self, head: dict | None, staged: Staged, keys: Sequence[str], repeated=False) -> list[str]:
        """Folders of the table once ``staged`` has replaced matching rows.
        ``repeated`` says that staged keys may come more than once."""
        if not head or not head["folders"] or not staged.rows:
            return [*(head["folders"] if head else ()), *(staged.folders if staged.rows or not head else ())]
        schema = T.StructType.fromJson(head["schema"])
        incoming = self.load(staged.folders, schema).select(*keys)
        incoming = (incoming.distinct() if repeated else incoming).alias("incoming")
        same_key = match_condition("present", "incoming", keys)
        near = head["folders"]
        if self.partition_by and set(self.partition_by) <= set(keys):
            # a key cannot be in a partition that no incoming row has
            arriving = {folder.partition("/")[2] for folder in staged.folders}
            near = [folder for folder in near if folder.partition("/")[2] in arriving]
        touched = self._folders_holding(near, schema, keys, incoming, same_key) if near else set()
        if not touched:
            return [*head["folders"], *staged.folders]
        present = self.load(sorted(touched), schema).alias("present")
        left = self.stage(present.join(incoming, same_key, "left_anti").select("present.*"))
        kept = [folder for folder in head["folders"] if folder not in touched]
        return [*kept, *(left.folders if left.rows else ()), *staged.folders]

    def _folders_holding(self, folders, schema, keys, incoming: DataFrame, same_key) -> set[str]:
        """Which folders have a row whose key comes in. Beside its key a row
        carries one number, made from the write and partition it belongs to."""
        partition_by = self.partition_by
        place = F.xxhash64("_write", *[F.col(f"`{c}`").cast("string") for c in partition_by])
        present = self._files(folders, schema).select(*keys, place.alias("_place")).alias("present")
        hit = present.join(incoming, same_key, "left_semi").select("_place").distinct()
        levels = F.split("folder", "/")
        value = [F.substring_index(levels[level], "=", -1) for level in range(1 + len(partition_by))]
        value[1:] = [
            F.when(v != NULL_PARTITION, F.url_decode(F.replace(v, F.lit("+"), F.lit("%2B")))) for v in value[1:]
        ]
        listed = self.spark.createDataFrame([(folder,) for folder in folders], "folder string")
        places = listed.select("folder", F.xxhash64(*value).alias("_place"))
        found = hit.join(places, "_place", "left").collect()
        if any(row.folder is None for row in found):
            raise FailedPrecondition("a row lies in a folder that its commit does not list")
        return {row.folder for row in found}

    # -- upkeep ------------------------------------------------------------

    def maintain(self, file_bytes: int = DEFAULT_FILE_BYTES, key: str = "") -> WriteResult:
        """Rewrite the table into files of about ``file_bytes`` bytes; in a partitioned
        table that is the most a file gets, as partitions have their own files."""
        done, head, version = self.begin(key, None)
        if done:
            return done
        if head is None:
            raise NotFound(f"{self.identifier} has no version on {self.branch}")
        schema = T.StructType.fromJson(head["schema"])
        folders = head["folders"]
        if folders:
            size = self._bytes(folders)
            rows = self.load(folders, schema)
            file_rows = 0
            if self.partition_by:
                file_rows = max(1, rows.count() * file_bytes // max(size, 1))
            else:
                rows = rows.repartition(max(1, -(-size // file_bytes)))
            folders = self.stage(rows, file_rows=file_rows).folders
        return self.commit(folders, schema, "maintain", None, version, key)

    def _bytes(self, folders) -> int:
        files = (
            self.spark.read.format("binaryFile")
            .option("recursiveFileLookup", True)
            .option("pathGlobFilter", "*.parquet")
            .load([f"{self.data}/{folder}" for folder in folders])
        )
        return files.agg(F.sum("length")).first()[0] or 0

    def unused_folders(self, keep_last: int) -> list[str]:
        """Write folders that none of the newest ``keep_last`` versions, on any
        branch, still lists. ``expire`` removes exactly these."""
        if keep_last < 1:
            raise InvalidArgument("keep at least one version")
        everything = self.spark.read.json(f"{self.path}/commits/*/*.json")
        place = F.regexp_extract(F.col("_metadata.file_path"), r"/commits/(.+)/[0-9]+\.json$", 1)
        commits = everything.select(place.alias("place"), "version", "folders")
        newest = commits.groupBy("place").agg(F.max("version").alias("newest"))
        listed = commits.join(newest, "place").withColumn("kept", F.col("version") > F.col("newest") - keep_last)
        named = listed.select("kept", F.explode("folders").alias("folder"))
        usage = named.groupBy(F.substring_index("folder", "/", 1).alias("write_id")).agg(F.max("kept").alias("kept"))
        return sorted(row.write_id for row in usage.where(~F.col("kept")).collect())

    def abandoned_folders(self, older_than_s: float = 86400.0) -> list[str]:
        """Write folders no commit lists whose newest file is older than that:
        what failed or refused writes left behind."""
        written = (
            self.spark.read.format("binaryFile")
            .option("recursiveFileLookup", True)
            .load(self.data)
            .select(F.regexp_extract("path", r"/data/(_write=[0-9a-f]{32})/", 1).alias("write_id"), "modificationTime")
            .groupBy("write_id")
            .agg(F.max("modificationTime").alias("newest"))
            .where(F.col("newest") < F.timestamp_seconds(F.lit(time.time() - older_than_s)))
        )
        commits = self.spark.read.schema("folders array<string>").json(f"{self.path}/commits/*/*.json")
        listed = commits.select(F.explode("folders").alias("folder"))
        used = listed.select(F.substring_index("folder", "/", 1).alias("write_id")).distinct()
        return sorted(row.write_id for row in written.join(used, "write_id", "left_anti").collect())

    def remove(self, folders: Sequence[str]) -> None:
        """Delete write folders from disk."""
        for folder in folders:
            target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.data}/{folder}")
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)

    def expire(self, keep_last: int) -> list[str]:
        """Delete the data only old versions need; those versions stop reading."""
        gone = self.unused_folders(keep_last)
        self.remove(gone)
        return gone

    # -- branches ----------------------------------------------------------

    def on(self, branch: str) -> VersionedTable:
        return VersionedTable(self.spark, self.path, self.identifier, branch, self._partition_by)

    def create_branch(self, branch: str) -> VersionedTable:
        """Start ``branch`` at this branch's head; an existing one is reset."""
        other = self.on(branch)
        head = self.head()
        if head is None:
            raise NotFound(f"{self.identifier} has no branch {self.branch}")
        there = other.head()
        other.commit(
            head["folders"],
            T.StructType.fromJson(head["schema"]),
            "branch",
            None,
            there["version"] if there else -1,
        )
        return other

    def merge_branch(self, branch: str, expected_snapshot: str = "", key: str = "") -> WriteResult:
        """Make this branch show what ``branch`` shows, unless it has moved on."""
        done = self.applied(key)
        if done:
            return done
        incoming, head = self.on(branch).head(), self.head()
        if incoming is None or head is None:
            raise NotFound(f"{self.identifier} lacks branch {branch if incoming is None else self.branch}")
        if expected_snapshot and expected_snapshot != head["snapshot_id"]:
            raise FailedPrecondition(f"{self.branch} is at {head['snapshot_id']}, not {expected_snapshot}")
        schema = T.StructType.fromJson(incoming["schema"])
        return self.commit(incoming["folders"], schema, "merge_branch", None, head["version"], key)


def conform(rows: DataFrame, schema: T.StructType, extra=()) -> DataFrame:
    """Same columns and types as the table, in its order, or an error."""
    have = {field.name: field.dataType for field in rows.schema.fields}
    for field in schema.fields:
        if have.get(field.name) != field.dataType:
            raise InvalidArgument(
                f"column {field.name} is {have.get(field.name)}, the table has {field.dataType}"
            )
    unknown = set(have) - set(schema.names) - set(extra)
    if unknown:
        raise InvalidArgument(f"columns {sorted(unknown)} are not in the table")
    return rows.select(*[F.col(f"`{name}`") for name in [*schema.names, *extra]])


def last_per_key(rows: DataFrame, keys, columns, ordering) -> DataFrame:
    """One row per key, the highest by ``ordering``, and how many there were.

    An aggregate and not a window, so copies of a hot key collapse before the
    shuffle. ``ordering`` must tell a key's rows apart.
    """
    payload = F.struct(*[F.col(f"`{name}`") for name in columns])
    latest = F.max_by(payload, F.struct(*ordering)).alias("_strata_row")
    grouped = rows.groupBy(*keys).agg(latest, F.count(F.lit(1)).alias("_strata_copies"))
    return grouped.select("_strata_row.*", "_strata_copies")
