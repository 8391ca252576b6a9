"""Operators for preparing training text; nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# Python functions travel to the executors by value: workers need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
