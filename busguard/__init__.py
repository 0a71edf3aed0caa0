"""busguard: vehicle-bus anomaly analytics on Spark."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions and classes of this package that run inside Python workers (grouped-map and pandas
# UDF bodies, the forest object) are pickled by value, so executors need no copy of the package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
