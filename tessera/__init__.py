"""Tessera: a PySpark-native analytics engine with an exactly specified SQL dialect."""

import sys

from pyspark import cloudpickle

__all__ = ["__version__"]
__version__ = "0.1.0"

# Functions that run in Python workers are sent whole, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
