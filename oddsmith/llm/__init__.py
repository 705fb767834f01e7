"""Operators for training-data pipelines; nothing outside this folder imports them."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel by value: a cluster needs no copy of this package there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
