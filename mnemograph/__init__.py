"""A PySpark-native analytics engine for attributable retrieval over a versioned memory graph."""

import sys

from pyspark import cloudpickle

# functions that run in tasks travel with the job, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
