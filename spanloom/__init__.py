"""Spark jobs that prepare and score text for long-context question answering."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions used in Python workers travel by value, so executors need no copy of
# this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
