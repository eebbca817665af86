"""Positional vector analytics on PySpark."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel by value: workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
