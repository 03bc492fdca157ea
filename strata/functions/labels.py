"""Label sets and ``k=v,k=v`` selectors as sorted arrays of (name, value), which
unlike maps can be grouped and joined on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space around names and values.
WHITE_SPACE = (
    "\t\n\v\f\r \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def _trim(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_SPACE))


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def selector_pairs(selector: Column) -> Column:
    """Pairs without "=" or without a name are skipped, a repeated name keeps
    its last value, and a blank selector has no pairs."""
    pieces = F.split(F.coalesce(selector, F.lit("")), ",")
    numbered = F.transform(
        pieces,
        lambda piece, at: F.struct(
            F.when(F.contains(piece, F.lit("=")), _trim(F.substring_index(piece, "=", 1))).alias("name"),
            at.alias("at"),
            _trim(piece.substr(F.instr(piece, "=") + 1, F.length(piece))).alias("value"),
        ),
    )
    named = F.array_sort(F.filter(numbered, lambda pair: F.length(pair["name"]) > 0))

    def last_of_name(pairs: Column) -> Column:
        return F.filter(
            pairs,
            lambda pair, at: ~F.get(pairs, at + 1)["name"].eqNullSafe(pair["name"]),
        )

    kept = _once(named, last_of_name)
    return F.transform(kept, lambda pair: F.struct(pair["name"].alias("name"), pair["value"].alias("value")))


def label_pairs(labels: Column) -> Column:
    """A map column as sorted (key, value) pairs."""
    return F.array_sort(F.map_entries(F.coalesce(labels, F.create_map().cast("map<string,string>"))))


def label_text(labels: Column) -> Column:
    """A map column as ``k=v,k=v`` in key order."""
    return F.array_join(F.transform(label_pairs(labels), lambda p: F.concat(p["key"], F.lit("="), p["value"])), ",")
