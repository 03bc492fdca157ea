"""The commit log of a table: one small JSON file per version.

Adding version N must fail when N is there already; that is the whole
concurrency guard. Locally a hard link does it, elsewhere a rename that refuses
an existing target (HDFS does). On an object store without such a rename, keep
one writer per table.
"""

from __future__ import annotations

import json
import os
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession

HISTORY = (
    "version bigint, snapshot_id string, mode string, rows_affected bigint, "
    "idempotency_key string, committed_at_ms bigint"
)


class CommitLog:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._files = _LocalFiles(folder) if _is_local(spark, folder) else _HadoopFiles(spark, folder)

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._files.names() if n.endswith(".json"))

    def read(self, version: int) -> dict:
        return json.loads(self._files.read(_file_name(version)))

    def add(self, version: int, record: dict) -> bool:
        """True if this call created the version, False if someone else has."""
        return self._files.create(_file_name(version), json.dumps(record))

    def history(self) -> DataFrame:
        """All versions as a table; dir lists and schemas are never loaded."""
        return self.spark.read.schema(HISTORY).json(self.folder)


def _file_name(version: int) -> str:
    return f"{version:020d}.json"


def _is_local(spark, folder) -> bool:
    scheme = urlparse(folder).scheme
    if scheme:
        return scheme == "file"
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
    return default.startswith("file:")


class _LocalFiles:
    def __init__(self, folder):
        self.folder = unquote(urlparse(folder).path) if folder.startswith("file:") else folder

    def names(self):
        return os.listdir(self.folder) if os.path.isdir(self.folder) else []

    def read(self, name):
        with open(os.path.join(self.folder, name), encoding="utf-8") as handle:
            return handle.read()

    def create(self, name, text):
        os.makedirs(self.folder, exist_ok=True)
        draft = os.path.join(self.folder, f".{uuid.uuid4().hex}")
        with open(draft, "w", encoding="utf-8") as handle:
            handle.write(text)
        try:
            os.link(draft, os.path.join(self.folder, name))
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)


class _HadoopFiles:
    def __init__(self, spark, folder):
        self._jvm = spark._jvm
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.folder = self._path(folder)
        self.fs = self.folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self):
        if not self.fs.exists(self.folder):
            return []
        return [status.getPath().getName() for status in self.fs.listStatus(self.folder)]

    def read(self, name):
        stream = self.fs.open(self._path(self.folder, name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name, text):
        self.fs.mkdirs(self.folder)
        draft = self._path(self.folder, f".{uuid.uuid4().hex}")
        stream = self.fs.create(draft, False)
        stream.write(text.encode("utf-8"))
        stream.close()
        final = self._path(self.folder, name)
        won = not self.fs.exists(final) and self.fs.rename(draft, final)
        if not won:
            self.fs.delete(draft, False)
        return won
