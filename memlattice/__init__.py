"""Analytics over conversational memory on Spark: declarative plans, built-in expressions, explicit reference times."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value, so that a cluster needs no copy of it there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
