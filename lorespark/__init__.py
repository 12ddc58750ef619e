"""Memory-and-knowledge-graph analytics as plain PySpark DataFrame functions."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# functions that run in Python workers travel with the plan, so executors need no copy of this package
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
