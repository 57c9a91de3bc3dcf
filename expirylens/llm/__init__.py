"""Operators for training-data pipelines; nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Functions go to the executors whole, so that these need not find the package on their own path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
