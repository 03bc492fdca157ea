"""Running a user function over batches of rows, reporting failure in-band."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class WorkReport:
    ok: bool
    rows: int | None
    snapshot_id: str = ""
    error: str = ""


def run_work(inputs: DataFrame, work: Callable, schema: str, target, key: str = "") -> WorkReport:
    """Apply ``work`` (an iterator of Arrow batches to an iterator of Arrow
    batches) on the executors and append the output to ``target``."""
    try:
        written = target.append(inputs.mapInArrow(work, schema), key=key)
    except PySparkException as problem:
        return WorkReport(False, None, error=str(problem))
    return WorkReport(True, written.rows_affected, written.snapshot_id)
