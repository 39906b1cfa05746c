"""caselattice: Spark-native analytics over registers of free-text cases and their vectors."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# functions for executors travel whole, so executors need no copy of this package
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
