"""Operators for large training-data pipelines. Nothing outside this folder imports them."""

import sys

from pyspark import cloudpickle

# Task functions travel to the executors by value: no copy of this package needs to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
