"""Searching listings and matching selectors to labelled providers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions.labels import selector_pairs
from strata.operators.skew import salted_join

SELECTED, NO_MATCH, AMBIGUOUS = "SELECTED", "NO_MATCH", "AMBIGUOUS"


def search(
    listings: DataFrame, text: str = "", kind: str = "", available: Sequence[str] = ()
) -> DataFrame:
    """Listings of a kind whose id or description holds the text, any case, and
    whose required capabilities are all available. Empty arguments do not filter."""
    found = listings
    if kind:
        found = found.where(F.col("kind") == kind)
    if text:
        needle = F.lit(text.lower())
        found = found.where(
            F.contains(F.lower("plugin_id"), needle) | F.contains(F.lower("description"), needle)
        )
    if available:
        have = F.array(*[F.lit(name) for name in available])
        found = found.where(F.size(F.array_except("required_capabilities", have)) == 0)
    return found


def select_provider(requests: DataFrame, providers: DataFrame) -> DataFrame:
    """Match (request_id, capability, selector) to (provider, capability, labels).

    A request is served when exactly one provider of its capability carries every
    label it asks for. Providers are counted per label values, once for each set of
    label names that selectors of their capability use, and requests look their
    count up: no request is ever paired with each provider. A capability that a
    third of all providers offer is spread over many tasks.
    """
    asked = requests.withColumn("pairs", selector_pairs(F.col("selector")))
    asked = asked.withColumn("names", F.transform("pairs", lambda p: p["name"])).withColumn(
        "values", F.transform("pairs", lambda p: p["value"])
    )
    name_sets = asked.select("capability", "names").distinct()
    offered = salted_join(providers, name_sets, ["capability"], by=["provider"]).select(
        "capability",
        "provider",
        "names",
        # a label that is not there reads as ""
        F.transform("names", lambda n: F.coalesce(F.element_at("labels", n), F.lit(""))).alias("values"),
    )
    counts = offered.groupBy("capability", "names", "values").agg(
        F.count(F.lit(1)).alias("matches"), F.min("provider").alias("provider")
    )
    looked_up = asked.join(counts, ["capability", "names", "values"], "left")
    matches = F.coalesce("matches", F.lit(0).cast("bigint"))
    outcome = F.when(matches == 1, SELECTED).when(matches == 0, NO_MATCH).otherwise(AMBIGUOUS)
    return looked_up.select(
        "request_id",
        matches.alias("matches"),
        outcome.alias("outcome"),
        F.when(matches == 1, F.col("provider")).alias("provider"),
    )
