"""Spark-native analytics over support logs, findings, identity traces and a small knowledge base."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions that run on executors are sent whole, so executors need no copy of this package.
register_pickle_by_value(sys.modules[__name__])
