"""Spark-native processing of posed range scans into queryable signed-distance fields."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the workers as code, so an executor needs no copy of the package on its path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
