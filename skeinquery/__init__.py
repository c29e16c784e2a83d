"""Spark-native web-search analytics: DataFrame in, DataFrame out."""

import sys

from pyspark import cloudpickle

# Executors get the package's functions by value, so a job needs no copy of the package on its nodes.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
