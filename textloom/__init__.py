"""Spark-native text analytics: byte scans, codecs, hashes, parsers, diffs and the aggregates over them."""

import sys

from pyspark import cloudpickle

# Functions travel to the Python workers by value: executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
