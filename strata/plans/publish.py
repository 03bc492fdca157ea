"""Write, audit, publish: rows become visible only after their checks pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from strata.plans.quality import Check, gate
from strata.sources.versioned import VersionedTable, WriteResult


def write_audit_publish(
    table: VersionedTable,
    rows: DataFrame,
    checks: Sequence[Check],
    key: str = "",
    expected_version: int | None = None,
    expected_rows: int | None = None,
) -> WriteResult:
    """Replace the table's rows if the checks pass on what was written and the
    table is still at the version this started from. Rows that fail are never
    listed by a commit."""
    done, _, version = table.begin(key, expected_version)
    if done:
        return done
    staged = table.stage(rows, expected_rows)
    gate(table.load(staged.folders, staged.schema), checks)
    return table.commit(staged.folders, staged.schema, "publish", staged.rows, version, key)
