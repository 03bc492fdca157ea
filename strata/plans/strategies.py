"""Load strategies: ways to bring a source into a versioned table.

Each takes an idempotency key, looks it up before starting any work, and returns
the write's result; a replay returns the first one with ``already_applied``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.errors import FailedPrecondition, InvalidArgument
from strata.operators import history, search
from strata.operators.history import DELTA_ORDER, EFFECTIVE_FROM, IS_CURRENT
from strata.operators.matching import any_different, match_condition
from strata.session import query, workspace
from strata.sources.versioned import VersionedTable, WriteResult, last_per_key


RETRIES = 5


def _guarded(target: VersionedTable, key: str, load: Callable[[int], WriteResult]) -> WriteResult:
    """Run a load that reads the target before it writes. ``load`` gets the version
    it is to read and to replace; if another writer commits in between, what was
    read is out of date, so it runs again on the new version."""
    for attempt in range(RETRIES + 1):
        done = target.applied(key)
        if done:
            return done
        version = target.version()
        try:
            return load(version)
        except FailedPrecondition:
            if attempt == RETRIES or target.version() == version:
                raise
    raise AssertionError("unreachable")


def _counted(target: VersionedTable, source: DataFrame, expected_rows: int | None) -> DataFrame:
    """The source itself, or, if it declares its size, a copy that has that size."""
    if expected_rows is None:
        return source
    staging = VersionedTable(target.spark, workspace(target.spark, "arrived"))
    arrived = staging.stage(source, expected_rows)
    return staging.load(arrived.folders, arrived.schema)


def full_refresh(
    target: VersionedTable, sql: str, sources: dict, run_id: str = "", expected_rows: int | None = None
) -> WriteResult:
    """Replace the target with the result of ``sql`` over the named sources. A run
    needs an id: without one, a later refresh would look like a replay."""
    if not sql:
        raise InvalidArgument("a full refresh needs a non-empty sql")
    if not run_id:
        raise InvalidArgument("a full refresh needs a run_id")
    result = target.applied(run_id)
    return result or target.overwrite(query(target.spark, sql, sources), key=run_id, expected_rows=expected_rows)


def append_load(target: VersionedTable, source: DataFrame, key: str = "", expected_rows=None) -> WriteResult:
    return target.append(source, key=key, expected_rows=expected_rows)


def high_water_mark(target: VersionedTable, watermark: str, version: int | None = None):
    """The target's largest watermark; parquet footers usually answer this."""
    if not target.exists():
        return None
    return target.read(version, columns=[watermark]).agg(F.max(watermark)).first()[0]


def not_yet_loaded(
    target: VersionedTable,
    source: DataFrame,
    unique_key: Sequence[str],
    watermark: str,
    version: int,
    lateness=None,
) -> DataFrame:
    """Source rows the target has still to get: of keys it does not hold, whatever
    their mark, and rows that replace what it holds of their key. A row replaces one
    of a lower mark, or one of the same mark that differs in some column; a null mark
    is lower than any other.

    Without ``lateness`` the target's keys are read as a whole. With it, rows whose
    mark lies further than that below the target's highest one are taken to be loaded
    already, on either side; rows without a mark are compared always.
    """
    if version < 0:
        return source
    mark = F.col(f"`{watermark}`")
    held = target.read(version)
    if lateness is not None:
        highest = high_water_mark(target, watermark, version)
        if highest is not None:
            recent = mark.isNull() | (mark >= F.lit(highest) - F.lit(lateness))
            source, held = source.where(recent), held.where(recent)
    columns = [name for name in source.columns if name in held.columns]
    incoming, present = F.col(f"s.`{watermark}`"), F.col(f"t.`{watermark}`")
    newer = F.coalesce(present > incoming, present.isNotNull() & incoming.isNull())
    loaded = newer | ~any_different("s", "t", columns)
    held = held.select(*[f"`{name}`" for name in columns]).alias("t")
    return source.alias("s").join(held, match_condition("s", "t", unique_key) & loaded, "left_anti")


def incremental(
    target: VersionedTable,
    source: DataFrame,
    unique_key: Sequence[str],
    watermark: str,
    key: str = "",
    expected_rows: int | None = None,
    lateness=None,
) -> WriteResult:
    """Merge the source rows the target has not got yet; of several rows for one key
    the one with the highest watermark stays. See ``not_yet_loaded``."""
    done = target.applied(key)
    if done:
        return done
    source = _counted(target, source, expected_rows)

    def load(version: int) -> WriteResult:
        fresh = not_yet_loaded(target, source, unique_key, watermark, version, lateness)
        return target.merge(fresh, unique_key, order_by=watermark, key=key, expected_version=version)

    return _guarded(target, key, load)


def delete_insert(
    target: VersionedTable, batch: DataFrame, keys: Sequence[str], key: str = "", expected_rows: int | None = None
) -> WriteResult:
    return target.delete_insert(batch, keys, key=key, expected_rows=expected_rows)


def snapshot(
    target: VersionedTable, source: DataFrame, taken_at: str, key: str = "", expected_rows: int | None = None
) -> WriteResult:
    """Append the whole source, stamped."""
    stamped = source.withColumn("snapshot_ts", F.lit(taken_at))
    return target.append(stamped, key=key, expected_rows=expected_rows)


def soft_delete(
    target: VersionedTable,
    source: DataFrame,
    keys: Sequence[str],
    run_id: str = "",
    expected_rows: int | None = None,
) -> WriteResult:
    """Make the target equal to the source, keeping rows the source has lost with
    ``is_deleted`` set. A key that comes back is live again. Give ``expected_rows``
    when the source declares its size: a truncated one would mark live rows deleted."""
    done = target.applied(run_id)
    if done:
        return done
    source = _counted(target, source, expected_rows)

    def load(version: int) -> WriteResult:
        if version < 0:
            marked = source.withColumn("is_deleted", F.lit(False))
        else:
            marked = history.mark_missing(target.read(version), source, keys)
        return target.overwrite(marked, key=run_id, expected_version=version)

    return _guarded(target, run_id, load)


def scd2(
    target: VersionedTable,
    source: DataFrame,
    natural_key: Sequence[str],
    tracked: Sequence[str],
    effective_from: str,
    expected_rows: int | None = None,
) -> WriteResult:
    """Close versions that changed or vanished and open new ones.

    ``rows_affected`` counts both, so a change counts 2; with nothing to do there
    is no new version. Give ``expected_rows`` when the source declares its size:
    a truncated source would otherwise close live versions.
    """
    if not natural_key or not tracked or not effective_from:
        raise InvalidArgument("scd2 needs natural_key, tracked and effective_from")
    key = f"{target.identifier}@{effective_from}"
    done = target.applied(key)
    if done:
        return done
    body = [*natural_key, *tracked]
    staging = VersionedTable(target.spark, workspace(target.spark, "scd2"))
    arrived = staging.stage(source.select(*body), expected_rows)
    staging.refuse_copies(arrived, natural_key)
    target.register(history.history_schema(source.select(*body).schema))
    incoming = staging.load(arrived.folders, arrived.schema)

    def load(version: int) -> WriteResult:
        open_versions = target.read(version, predicate=IS_CURRENT)
        delta = history.history_delta(open_versions, incoming, natural_key, tracked, effective_from)
        keys = [*natural_key, EFFECTIVE_FROM]
        return target.merge(delta, keys, order_by=DELTA_ORDER, key=key, expected_version=version, skip_empty=True)

    return _guarded(target, key, load)


def scd2_table(spark, path: str, identifier: str | None = None) -> VersionedTable:
    """A history table whose open versions sit apart, so a load neither scans nor
    rewrites the closed ones when it looks for changes."""
    return VersionedTable(spark, path, identifier, partition_by=(IS_CURRENT,))


def scd2_as_of(target: VersionedTable, moment: str) -> DataFrame:
    return history.as_of(target.read(), moment)


def incremental_embed(
    target: VersionedTable,
    source: DataFrame,
    unique_key: Sequence[str],
    text_column: str,
    watermark: str,
    key: str = "",
    expected_rows: int | None = None,
    lateness=None,
) -> WriteResult:
    """Merge the rows the target has not got yet with their embedding; rows that
    already have a vector are left alone."""
    done = target.applied(key)
    if done:
        return done
    source = _counted(target, source, expected_rows)

    def load(version: int) -> WriteResult:
        fresh = not_yet_loaded(target, source, unique_key, watermark, version, lateness)
        if version >= 0:
            unembedded = target.read(version).where(F.col("embedding").isNull()).drop("embedding").alias("t")
            arriving = fresh.select(*unique_key).distinct().alias("s")
            same = match_condition("t", "s", unique_key)
            fresh = fresh.unionByName(unembedded.join(arriving, same, "left_anti"))
        latest = last_per_key(fresh, unique_key, fresh.columns, [watermark]).drop("_strata_copies")
        embedded = search.embed(latest, text_column)
        return target.merge(embedded, unique_key, key=key, expected_version=version)

    return _guarded(target, key, load)
