"""marketloom: market panel analytics as Spark jobs."""

from pyspark import cloudpickle as _cloudpickle
import sys as _sys

# Helpers that run inside tasks travel with the task, so executors need no copy of the package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
