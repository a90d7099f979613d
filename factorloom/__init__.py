"""factorloom: a Spark-native engine for time-series factor research."""

import sys

from pyspark import cloudpickle

# Functions shipped to executors travel by value, so workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
