"""Fjordex: text retrieval and corpus analytics as plain Spark plans."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package travel to the executors by value, so that a worker needs no copy of the package on its path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
