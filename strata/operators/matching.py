"""Null-safe key matching."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def match_condition(left: str, right: str, keys: Sequence[str]) -> Column:
    """All keys equal between two aliased sides, with null equal to null."""
    pairs = (F.col(f"{left}.`{key}`").eqNullSafe(F.col(f"{right}.`{key}`")) for key in keys)
    return reduce(lambda a, b: a & b, pairs, F.lit(True))


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Like ``left.join(right, keys, how)``, with null equal to null. Inner and left
    joins only; the left side's keys stay."""
    others = [F.col(f"_r.`{name}`") for name in right.columns if name not in keys]
    joined = left.alias("_l").join(right.alias("_r"), match_condition("_l", "_r", keys), how)
    return joined.select("_l.*", *others)


def any_different(left: str, right: str, columns: Sequence[str]) -> Column:
    """At least one column differs, null counting as a value."""
    pairs = (~F.col(f"{left}.`{c}`").eqNullSafe(F.col(f"{right}.`{c}`")) for c in columns)
    return reduce(lambda a, b: a | b, pairs, F.lit(False))
