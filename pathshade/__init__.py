"""Spark-native analytics for placing facilities on pedestrian networks."""

import sys

from pyspark import cloudpickle

# Functions go to Python workers by value: workers need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
