"""Conditional delay and tail-risk analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# What runs in Python workers travels by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
