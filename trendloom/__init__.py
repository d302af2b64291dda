"""Topic discovery and topic trends over document collections, on Spark."""

import sys

from pyspark import cloudpickle

# Tasks receive the package's functions by value: executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
