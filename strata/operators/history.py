"""Comparing snapshots and keeping their history (slowly changing dimension, type 2)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.errors import InvalidArgument
from strata.operators.bands import number_of
from strata.operators.matching import any_different, match_condition
from strata.operators.ordered import BLOCK_ROWS, numbered, running

# The metadata columns of a history table; "" marks an open version.
EFFECTIVE_FROM = "effective_from"
EFFECTIVE_TO = "effective_to"
IS_CURRENT = "is_current"
OPEN = ""
DELTA_ORDER = "delta_order"


def history_schema(body: T.StructType) -> T.StructType:
    """The columns of a history table over ``body``."""
    metadata = {EFFECTIVE_FROM: T.StringType(), EFFECTIVE_TO: T.StringType(), IS_CURRENT: T.BooleanType()}
    return T.StructType([*body.fields, *[T.StructField(name, kind) for name, kind in metadata.items()]])


def _paired(old: DataFrame, new: DataFrame, keys: Sequence[str], tracked: Sequence[str]) -> DataFrame:
    """Full outer pairing on null-safe keys; keys are unique on both sides, so no
    key is hot. A side that is absent is a null struct."""
    left = old.select(*keys, F.struct(*old.columns).alias("old")).alias("l")
    right = new.select(*keys, F.struct(*new.columns).alias("new")).alias("r")
    both = left.join(right, match_condition("l", "r", keys), "full_outer")
    change = (
        F.when(F.col("l.old").isNull(), "new")
        .when(F.col("r.new").isNull(), "deleted")
        .when(any_different("l.old", "r.new", tracked), "changed")
        .otherwise("unchanged")
    )
    return both.select(F.col("l.old").alias("old"), F.col("r.new").alias("new"), change.alias("change"))


def snapshot_diff(old: DataFrame, new: DataFrame, keys: Sequence[str], tracked: Sequence[str]) -> DataFrame:
    """One row per key of either snapshot: new, changed, unchanged or deleted."""
    pairs = _paired(old.select(*keys, *tracked), new.select(*keys, *tracked), keys, tracked)
    return pairs.select(
        *[F.coalesce(F.col("new")[k], F.col("old")[k]).alias(k) for k in keys],
        "change",
        *[F.col("old")[c].alias(f"old_{c}") for c in tracked],
        *[F.col("new")[c].alias(f"new_{c}") for c in tracked],
    )


def history_delta(
    open_versions: DataFrame, source: DataFrame, keys: Sequence[str], tracked: Sequence[str], effective_from: str
) -> DataFrame:
    """Rows to merge on (keys, effective_from), in ``DELTA_ORDER``: closed versions
    and new ones. When a run repeats its own ``effective_from``, both rows of a
    change share that key and the new one wins, leaving no history row."""
    current = open_versions.select(*keys, *tracked, EFFECTIVE_FROM)
    pairs = _paired(current, source.select(*keys, *tracked), keys, tracked).where(F.col("change") != "unchanged")
    body = [*keys, *tracked]
    closed = F.struct(
        *[F.col("old")[c].alias(c) for c in body],
        F.col("old")[EFFECTIVE_FROM].alias(EFFECTIVE_FROM),
        F.lit(effective_from).alias(EFFECTIVE_TO),
        F.lit(False).alias(IS_CURRENT),
        F.lit(0).alias(DELTA_ORDER),
    )
    opened = F.struct(
        *[F.col("new")[c].alias(c) for c in body],
        F.lit(effective_from).alias(EFFECTIVE_FROM),
        F.lit(OPEN).alias(EFFECTIVE_TO),
        F.lit(True).alias(IS_CURRENT),
        F.lit(1).alias(DELTA_ORDER),
    )
    emitted = (
        F.when(F.col("change") == "new", F.array(opened))
        .when(F.col("change") == "deleted", F.array(closed))
        .otherwise(F.array(closed, opened))
    )
    return pairs.select(F.explode(emitted).alias("row")).select("row.*")


def as_of(history: DataFrame, moment: str) -> DataFrame:
    """The versions in force at ``moment``."""
    started = F.col(EFFECTIVE_FROM) <= moment
    not_ended = (F.col(EFFECTIVE_TO) == OPEN) | (F.col(EFFECTIVE_TO) > moment)
    return history.where(started & not_ended)


def _comparable(kinds: Sequence[T.DataType]) -> list[Callable[[Column], Column]]:
    """How to turn times of these types into values that compare with each other."""
    text = [isinstance(kind, T.StringType) for kind in kinds]
    if all(text):
        return [lambda c: F.nullif(c, F.lit(OPEN))] * len(kinds)
    others = [kind for kind, is_text in zip(kinds, text) if not is_text]
    numbers = [isinstance(kind, T.NumericType) for kind in others]
    if any(numbers) and (any(text) or not all(numbers)):
        raise InvalidArgument(f"{', '.join(kind.simpleString() for kind in kinds)} do not compare as times")
    read = lambda c: number_of(F.nullif(c, F.lit(OPEN)).cast("timestamp"), T.TimestampType())
    return [read if is_text else (lambda c, kind=kind: number_of(c, kind)) for kind, is_text in zip(kinds, text)]


def as_of_join(
    facts: DataFrame,
    versions: DataFrame,
    keys: Sequence[str],
    fact_time: str,
    version_time: str,
    columns: Sequence[str],
    until: str | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Each fact with ``columns`` of the version of its key that was in force at its
    time: the last one that began by then, unless it had ended (``until``, null or ""
    while it is open). Without one, or without a time, they are null. Null is a key.

    Times are numbers, or dates and times, or strings; numbers of different types
    compare by value, a date is its midnight, and where strings meet dates or times
    they are read as such, otherwise they compare as they are.

    Both sides are one log per key, in which the last version is carried forward. The
    log is worked on in blocks of ``block_rows`` rows, of which later ones need a single
    row of the earlier ones, so neither a key with very many facts nor one with very
    many versions is a task of its own, and no pairs are made. Of versions that begin
    together the largest by ``until`` and ``columns`` counts.
    """
    named = [(facts, fact_time), (versions, version_time), *([(versions, until)] if until else [])]
    at = [turn(F.col(f"`{c}`")) for (_, c), turn in zip(named, _comparable([side.schema[c].dataType for side, c in named]))]
    ends = [at[2].alias("_until")] if until else []
    carried = F.struct(at[1].alias("_since"), *ends, *[F.col(f"`{c}`") for c in columns])
    log = facts.select(*keys, F.struct(*[F.col(f"`{c}`") for c in facts.columns]).alias("_fact"), at[0].alias("_time"), F.lit(1).alias("_side")).unionByName(
        versions.where(at[1].isNotNull()).select(*keys, carried.alias("_version"), at[1].alias("_time"), F.lit(0).alias("_side")),
        allowMissingColumns=True,
    )
    placed = numbered(log, [*keys, "_time", "_side"], "_at", block_rows)
    seen = running(placed, keys, "_at", {"_seen": ("max", F.col("_version"))}, block_rows).where(F.col("_fact").isNotNull())
    in_force = F.lit(True)
    if until:
        in_force = F.coalesce(F.col("_seen._until") > F.col("_time"), F.lit(True))
    return seen.select("_fact.*", *[F.when(in_force, F.col("_seen")[c]).alias(c) for c in columns])


def mark_missing(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Source rows as they are; target rows the source lacks, flagged deleted."""
    columns = source.columns
    present = source.select(*keys).distinct().alias("s")
    gone = target.alias("t").join(present, match_condition("t", "s", keys), "left_anti")
    return source.withColumn("is_deleted", F.lit(False)).unionByName(
        gone.select(*columns).withColumn("is_deleted", F.lit(True))
    )
