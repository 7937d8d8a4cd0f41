"""Operators: a DataFrame in, a DataFrame out. Functions that run on executors are pickled by value, so a cluster needs no copy of them."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
