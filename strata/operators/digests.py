"""What changed between two snapshots, by digests first.

A snapshot's rows fall into ranges of keys by hash, ranges into groups. A range's digest
is made of its rows' hashes, whatever their order, and a group's of its ranges'. Groups
with equal digests are skipped, then ranges; only rows of ranges that differ are joined.
Digests are small (one for every ``RANGE_ROWS`` rows) and can be kept with a snapshot,
so that of an unchanged past only they are read.

A digest is a count, a sum and an exclusive or of 64-bit row hashes, so two different
ranges pass for equal with a chance of about 2**-120.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.operators.history import snapshot_diff

RANGE_ROWS = 8
GROUP = 1024  # ranges


def _hash(columns: Sequence[str], seed: int) -> Column:
    """Nulls leave a running hash as it is, so whether a value is there goes in, too."""
    parts = [part for c in columns for part in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    return F.xxhash64(F.lit(seed), *parts)


def ranges_for(rows: int) -> int:
    return max(1, rows // RANGE_ROWS)


def _placed(snapshot: DataFrame, keys: Sequence[str], ranges: int) -> DataFrame:
    return snapshot.withColumn("_range", F.pmod(_hash(keys, 1), F.lit(ranges)))


def digests(snapshot: DataFrame, keys: Sequence[str], tracked: Sequence[str], ranges: int) -> DataFrame:
    """(group, range, rows, total, mixed) of each range that has rows."""
    whole = [*keys, *tracked]
    hashed = _placed(snapshot, keys, ranges).select("_range", _hash(whole, 2).alias("a"), _hash(whole, 3).alias("b"))
    return hashed.groupBy(F.floor(F.col("_range") / GROUP).alias("group"), F.col("_range").alias("range")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("a").cast("decimal(38,0)")).alias("total"), F.bit_xor("b").alias("mixed")
    )


def changed_ranges(old: DataFrame, new: DataFrame) -> DataFrame:
    """The ranges whose digests differ, or that one side lacks."""
    mark = [F.col("rows"), F.col("total"), F.col("mixed")]
    grouped = lambda d: d.groupBy("group").agg(
        F.sum(F.xxhash64("range", *mark).cast("decimal(38,0)")).alias("total"), F.bit_xor(F.xxhash64(F.lit(1), "range", *mark)).alias("mixed"), F.sum("rows").alias("rows")
    )
    groups = _unequal(grouped(old), grouped(new), "group")
    within = lambda d: d.join(groups, "group", "left_semi")
    return _unequal(within(old), within(new), "range")


def _unequal(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    mark = F.struct("rows", "total", "mixed")
    one, other = old.select(key, mark.alias("old")), new.select(key, mark.alias("new"))
    return one.join(other, key, "full_outer").where(~F.col("old").eqNullSafe(F.col("new"))).select(key)


def diff_by_digests(
    old: DataFrame,
    new: DataFrame,
    keys: Sequence[str],
    tracked: Sequence[str],
    ranges: int,
    old_digests: DataFrame | None = None,
    new_digests: DataFrame | None = None,
    unchanged: bool = False,
) -> DataFrame:
    """The rows of ``snapshot_diff``; unchanged keys only if asked for, those of equal
    ranges without a join. Digests that were kept are taken instead of being made; they
    are of the same keys, columns and number of ranges. Keys are unique, null is one."""
    before = digests(old, keys, tracked, ranges) if old_digests is None else old_digests
    after = digests(new, keys, tracked, ranges) if new_digests is None else new_digests
    apart = changed_ranges(before, after).withColumnRenamed("range", "_range")
    columns = [*keys, *tracked]
    some = lambda rows, how: _placed(rows.select(*columns), keys, ranges).join(apart, "_range", how).drop("_range")
    found = snapshot_diff(some(old, "left_semi"), some(new, "left_semi"), keys, tracked)
    if not unchanged:
        return found.where("change <> 'unchanged'")
    same = some(new, "left_anti").select(
        *keys, F.lit("unchanged").alias("change"), *[F.col(f"`{c}`").alias(f"{side}_{c}") for side in ("old", "new") for c in tracked]
    )
    return found.unionByName(same)
