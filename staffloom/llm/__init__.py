"""Operators for preparing training data at scale; nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# tasks carry this package's functions by value, so executors need no copy of it
cloudpickle.register_pickle_by_value(sys.modules[__name__])
