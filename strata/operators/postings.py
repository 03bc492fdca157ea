"""Many substring searches at once, by posting lists.

Every listing is filed under the runs of ``GRAM`` characters in its text, and under
those of fewer, for shorter needles. A needle can only be in listings filed under all of
its own runs, so it looks into the list of the rarest and checks what it finds there.
Lists longer than ``SLICE_ROWS`` are read in slices, by as many tasks.

Short needles are in a fair part of all listings, so pairs grow with the product of both
sides. Where only totals over what is found are wanted, listings are filed under runs of
up to ``WHOLE`` characters and each run's list is added up before anybody looks into it:
a needle of that length reads one row, and nothing grows faster than the text.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.errors import InvalidArgument

GRAM = 3
WHOLE = 8
SLICE_ROWS = 50_000
_TOTALS = {"count": F.sum, "min": F.min, "max": F.max}


def _grams(text: Column, size: int) -> Column:
    """The different runs of ``size`` characters; for 0 the one empty run."""
    if size == 0:
        return F.array(F.lit(""))
    starts = F.sequence(F.lit(1), F.length(text) - (size - 1))
    cut = F.array_distinct(F.transform(starts, lambda at: F.substring(text, at, F.lit(size))))
    return F.when(F.length(text) >= size, cut).otherwise(F.array().cast("array<string>"))


def posted(listings: DataFrame, id: str, texts: list[str]) -> DataFrame:
    """(gram, id) for every listing and run of up to ``GRAM`` characters of any of its
    texts, lower-cased; null texts have none but the empty one."""
    parts = [_grams(F.lower(F.coalesce(F.col(f"`{t}`"), F.lit(""))), size) for t in texts for size in range(GRAM + 1)]
    return listings.select(F.col(f"`{id}`").alias("id"), F.explode(F.array_distinct(F.flatten(F.array(*parts)))).alias("gram"))


def search_many(
    requests: DataFrame,
    listings: DataFrame,
    id: str,
    texts: list[str],
    index: DataFrame | None = None,
    condition: Column | None = None,
    slice_rows: int = SLICE_ROWS,
    totals: Mapping[str, tuple[str, Column]] | None = None,
    same: Mapping[str, str] | None = None,
) -> DataFrame:
    """(request columns, listing columns) of every request (request_id, query) and
    listing whose texts hold the query, whatever the case. An empty or null query is in
    every listing. ``condition`` is over both sides' columns, which share no names; ids
    are unique. ``index`` is what ``posted`` made of the listings, if it was kept.

    ``same`` maps request columns to listing columns that must be equal. With ``totals``
    ("count", "min" or "max" of a column over the listings) there is a row for each
    request that finds anything, (request columns, totals), and no pairs are made but
    for needles longer than ``WHOLE``; ``condition`` and ``index`` are not for these.
    """
    if totals is not None:
        if condition is not None or index is not None:
            raise InvalidArgument("totals take neither a condition nor an index")
        return _totalled(requests, listings, id, texts, totals, dict(same or {}), slice_rows)
    for mine, theirs in (same or {}).items():
        equal = F.col(f"`{mine}`") == F.col(f"`{theirs}`")
        condition = equal if condition is None else condition & equal
    filed = posted(listings, id, texts) if index is None else index
    needle = F.lower(F.coalesce("query", F.lit("")))
    asked = requests.select("request_id", needle.alias("needle"))
    size = F.least(F.length("needle"), F.lit(GRAM))
    runs = F.when(size == 0, _grams(F.col("needle"), 0))
    for n in range(1, GRAM + 1):
        runs = runs.when(size == n, _grams(F.col("needle"), n))
    wanted = asked.select("request_id", "needle", F.explode(runs).alias("gram"))
    # how long the lists are that anybody looks into; a run without one finds nothing
    lengths = filed.join(wanted.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("length"))
    listed = wanted.join(lengths, "gram", "left")
    rarest = F.min(F.struct(F.coalesce("length", F.lit(0)).alias("length"), "gram")).alias("rarest")
    chosen = listed.groupBy("request_id", "needle").agg(rarest).select("request_id", "needle", "rarest.*").where("length > 0")
    slices = F.ceil(F.col("length") / slice_rows)
    lists = chosen.select("gram", slices.alias("slices")).distinct()
    dealt = filed.join(lists, "gram").select("gram", "id", F.pmod(F.xxhash64("id"), F.col("slices")).alias("slice"))
    looking = chosen.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("bigint"), slices - 1)))
    candidates = looking.join(dealt, ["gram", "slice"]).select("request_id", "needle", "id")
    whole = F.struct(*[F.col(f"`{c}`") for c in listings.columns]).alias("listing")
    found = candidates.join(listings.select(F.col(f"`{id}`").alias("id"), whole), "id")
    holds = F.col("needle") == ""
    for text in texts:
        holds = holds | F.coalesce(F.contains(F.lower(F.col("listing")[text]), F.col("needle")), F.lit(False))
    both = requests.join(found.where(holds).select("request_id", "listing"), "request_id").select(*requests.columns, "listing.*")
    return both.where(condition) if condition is not None else both


def _totalled(requests: DataFrame, listings: DataFrame, id: str, texts: list[str], totals: Mapping, same: dict[str, str], slice_rows: int) -> DataFrame:
    """A row for each request that finds anything."""
    keys = [f"_k{i}" for i in range(len(same))]
    asked = requests.where("request_id IS NOT NULL").select(
        F.struct(*[F.col(f"`{c}`") for c in requests.columns]).alias("_request"), F.lower(F.coalesce("query", F.lit(""))).alias("_needle"),
        *[F.col(f"`{c}`").alias(k) for k, c in zip(keys, same)],
    )
    longest = asked.agg(F.max(F.length("_needle"))).first()[0] or 0
    words, inputs = [f"_t{i}" for i in range(len(texts))], [f"_in{i}" for i in range(len(totals))]
    some = listings.where(F.col(f"`{id}`").isNotNull()).select(
        F.col(f"`{id}`").alias("_id"), *[F.lower(F.coalesce(F.col(f"`{t}`"), F.lit(""))).alias(w) for w, t in zip(words, texts)],
        *[F.col(f"`{c}`").alias(k) for k, c in zip(keys, same.values())], *[column.alias(n) for n, (_, column) in zip(inputs, totals.values())],
    )
    # pairs are made by id, so that each copy of a listing is found by all of them
    some = some.groupBy(*some.columns).agg((F.count(F.lit(1)) * F.count(F.lit(1))).alias("_times"))
    kinds = {name: (kind, given) for (name, (kind, _)), given in zip(totals.items(), inputs)}
    added = [_TOTALS[kind](F.when(F.col(n).isNotNull(), F.col("_times")).otherwise(0) if kind == "count" else F.col(n)).alias(name) for name, (kind, n) in kinds.items()]
    runs = [_grams(F.col(w), size) for w in words for size in range(min(longest, WHOLE) + 1)]
    filed = some.select(*keys, *inputs, "_times", F.explode(F.array_distinct(F.flatten(F.array(*runs)))).alias("_needle"))
    found = asked.join(filed.groupBy("_needle", *keys).agg(*added), ["_needle", *keys])
    if longest > WHOLE:
        questions = asked.where(F.length("_needle") > WHOLE).select("_needle", *keys).distinct()
        numbered = questions.select(F.struct("_needle", *keys).alias("request_id"), F.col("_needle").alias("query"))
        equal = {f"_asked{i}": k for i, k in enumerate(keys)}
        numbered = numbered.select("*", *[F.col(f"request_id.{k}").alias(a) for a, k in equal.items()])
        # rows of the same id are told apart, their copies are counted already
        apart = some.withColumn("_id", F.struct("_id", *words, *keys, *inputs))
        pairs = search_many(numbered, apart, "_id", words, slice_rows=slice_rows, same=equal)
        found = found.unionByName(asked.join(pairs.groupBy("request_id").agg(*added).select("request_id._needle", *[f"request_id.{k}" for k in keys], *kinds), ["_needle", *keys]))
    return found.select("_request.*", *kinds)
