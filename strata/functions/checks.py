"""Shape checks on keys and trace ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The limits of the key grammar and the lengths of a trace id.
MAX_KEY_BYTES = 512
CONTROL_CHARACTERS = r"[\x00-\x1F]"
DOT_COMPONENTS = (".", "..")
TRAVERSALS = ("../", "..\\")
TRACE_LENGTHS = (2, 32, 16, 2)


def valid_key(key: Column, allow_empty: bool = False) -> Column:
    size = F.octet_length(key)
    bad = F.exists(F.split(key, "/"), lambda part: part.isin(*DOT_COMPONENTS))
    for piece in TRAVERSALS:
        bad = bad | F.contains(key, F.lit(piece))
    fits = size.between(0 if allow_empty else 1, MAX_KEY_BYTES)
    return F.coalesce(fits & ~key.rlike(CONTROL_CHARACTERS) & ~bad, F.lit(False))


def well_formed_trace(trace: Column) -> Column:
    """Four dash-separated parts of the right lengths; contents are not looked at."""
    parts = F.split(trace, "-")
    good = F.size(parts) == len(TRACE_LENGTHS)
    for at, length in enumerate(TRACE_LENGTHS):
        good = good & (F.length(F.get(parts, F.lit(at))) == length)
    return F.coalesce(good, F.lit(False))
