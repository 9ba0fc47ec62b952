"""Operators for preparing training text at corpus scale; nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# functions that run in tasks travel by value, so executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
