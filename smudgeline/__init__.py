"""Noisy text lines on Spark: make them, clean them, match them to a closed catalog."""

import sys

from pyspark import cloudpickle

# the functions run in Python workers are sent whole, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
