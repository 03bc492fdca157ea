"""strata: versioned tables, load strategies, quality gates and operational
datasets as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

from strata.errors import FailedPrecondition, InvalidArgument, NotFound
from strata.session import build_session, execute, preview, query, workspace
from strata.sources.versioned import VersionedTable, WriteResult

__all__ = [
    "FailedPrecondition",
    "InvalidArgument",
    "NotFound",
    "VersionedTable",
    "WriteResult",
    "build_session",
    "execute",
    "preview",
    "query",
    "workspace",
]

# Functions reach the executors by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
