"""Spark-native analytics for imaging catalogs and training corpora."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value, so executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
