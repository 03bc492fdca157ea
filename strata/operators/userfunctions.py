"""Functions written in Python and used from SQL: one that reads a key's rows in order
and returns rows, and one that makes a number of a group's column.

    install(spark)
    SELECT * FROM sessions(TABLE(events) PARTITION BY (user_id) ORDER BY (ts), 'ts', 1800)
    SELECT user_id, gini(value) FROM events GROUP BY user_id

They are patterns for what a user brings along. Rows of a key pass through one task one
at a time and are not kept; the column of a group is in one task as a whole, so groups
of an aggregate have to fit there.
"""

from __future__ import annotations

import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf, udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

SESSION = "session"


class Sessions:
    """The rows of a table argument, whatever its columns, each with the number of its
    session within the partition: a new one begins where more than ``seconds`` have
    passed since the row before. Rows without a time (they come first or last, as the
    ordering says) belong to no session."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, time: AnalyzeArgument, seconds: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("the first argument is a table")
        if time.value not in rows.dataType.names:
            raise ValueError(f"the table has no column {time.value}")
        if SESSION in rows.dataType.names:
            raise ValueError(f"the table has a column {SESSION}")
        return AnalyzeResult(schema=T.StructType([*rows.dataType.fields, T.StructField(SESSION, T.LongType())]))

    def __init__(self):
        self._last, self._number = None, 0

    def eval(self, row, time, seconds):
        at = row[time]
        if at is None:
            yield (*row, None)
            return
        if self._last is None or at - self._last > datetime.timedelta(seconds=float(seconds)):
            self._number += 1
        self._last = at
        yield (*row, self._number)


def _gini(values: pa.Array) -> float | None:
    """How unevenly a sum is spread: 0 if all values are equal. Nulls are left out; a
    group without values, or whose sum is zero, has none."""
    held = np.sort(values.drop_null().to_numpy(zero_copy_only=False).astype(np.float64))
    n, total = len(held), held.sum()
    if not n or not total:
        return None
    return float((2 * np.arange(1, n + 1) - n - 1) @ held / (n * total))


def install(spark: SparkSession) -> None:
    """Make both known to a session's SQL."""
    spark.udtf.register("sessions", udtf(Sessions))
    spark.udf.register("gini", arrow_udf(_gini, "double"))
