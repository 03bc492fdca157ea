"""Data tests: each yields a count of violations, and zero passes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.errors import FailedPrecondition, InvalidArgument

ERROR, WARN = "error", "warn"


@dataclass(frozen=True)
class Check:
    """One test. ``kind`` is not_null, unique or assertion; an assertion is a
    function from the tested DataFrame to its violating rows."""

    name: str
    kind: str
    columns: Sequence[str] = ()
    severity: str = ERROR
    violating: object = field(default=None, compare=False)


def not_null(column: str, severity: str = ERROR) -> Check:
    return Check(f"not_null_{column}", "not_null", (column,), severity)


def unique(*columns: str, severity: str = ERROR) -> Check:
    return Check(f"unique_{'_'.join(columns)}", "unique", columns, severity)


def assertion(name: str, violating, severity: str = ERROR) -> Check:
    return Check(name, "assertion", (), severity, violating)


def report(frame: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """One row per check: (test, severity, violations, passed).

    All not_null checks share one pass over the data, and all unique checks another
    and one shuffle. A unique check counts the values that occur more than once,
    ignoring nulls.
    """
    parts = []
    nulls = [c for c in checks if c.kind == "not_null"]
    if nulls:
        counted = frame.agg(
            F.array(
                *[
                    F.struct(
                        F.lit(c.name).alias("test"),
                        F.lit(c.severity).alias("severity"),
                        F.count_if(F.col(c.columns[0]).isNull()).alias("violations"),
                    )
                    for c in nulls
                ]
            ).alias("rows")
        )
        parts.append(counted.select(F.inline("rows")))
    uniques = [c for c in checks if c.kind == "unique"]
    if uniques:
        parts.append(_repeated(frame, uniques))
    for check in checks:
        if check.kind != "assertion":
            continue
        parts.append(
            check.violating(frame).agg(F.count(F.lit(1)).alias("violations")).select(
                F.lit(check.name).alias("test"), F.lit(check.severity).alias("severity"), "violations"
            )
        )
    if not parts:
        raise InvalidArgument("a report needs at least one check")
    everything = parts[0]
    for part in parts[1:]:
        everything = everything.unionByName(part)
    return everything.withColumn("passed", F.col("violations") == 0)


def _repeated(frame: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """How many values of each unique check occur more than once. Every row is keyed
    by its values, one struct per check, of which all but one are null."""
    keys = [F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(check.columns)]) for check in checks]
    tried = []
    for number, (check, key) in enumerate(zip(checks, keys)):
        whole = F.lit(True)
        for column in check.columns:
            whole = whole & F.col(f"`{column}`").isNotNull()
        others = [F.when(F.lit(n == number) & whole, k).alias(f"k{n}") for n, k in enumerate(keys)]
        tried.append(F.struct(F.lit(number).alias("check"), *others))
    rows = frame.select(F.explode(F.array(*tried)).alias("row")).select("row.*")
    values = [F.col(f"k{n}") for n in range(len(checks))]
    present = F.lit(False)
    for value in values:
        present = present | value.isNotNull()
    counted = rows.where(present)
    copies = counted.groupBy("check", *values).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    found = copies.groupBy("check").agg(F.count(F.lit(1)).alias("violations"))
    # one row per check, also for those without a violation
    names = F.array(*[F.struct(F.lit(n).alias("check"), F.lit(c.name).alias("test"), F.lit(c.severity).alias("severity")) for n, c in enumerate(checks)])
    listed = frame.sparkSession.range(1).select(F.inline(names))
    return listed.join(found, "check", "left").select("test", "severity", F.coalesce("violations", F.lit(0)).alias("violations"))


def gate(frame: DataFrame, checks: Sequence[Check]) -> list:
    """Run the checks; violations of "error" severity raise, others come back."""
    if not checks:
        return []
    rows = report(frame, checks).collect()
    blocking = [r for r in rows if not r.passed and r.severity == ERROR]
    if blocking:
        raise FailedPrecondition("; ".join(f"{r.test}: {r.violations} violations" for r in blocking))
    return rows
