"""Importing this registers all queries of the subpackage."""

from strata.llm import (  # noqa: F401
    alignment, chat, clusters, decontaminate, jaccard, language, licenses, mixing, pii, quality, substrings, subwords, toxicity,
)
from strata.llm.registry import ORACLES, QUERIES  # noqa: F401
