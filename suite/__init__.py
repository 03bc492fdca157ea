"""Queries over the test tables, each with SQL that must agree."""

import sys

from pyspark import cloudpickle

# The work functions here are not installed on executors either.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
