"""sedimenta: indexed lakehouse tables and analytics, expressed as Spark plans."""

import sys

from pyspark import cloudpickle

# Functions that Spark ships to Python workers travel by value, so the workers
# need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
