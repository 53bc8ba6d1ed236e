"""Corpus analytics on Spark: every operator maps DataFrames to DataFrames, or Columns to Columns."""

import sys

from pyspark import cloudpickle

# Ship this package's functions to the executors by value, so that nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
