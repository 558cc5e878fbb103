"""Operators for training-data pipelines; nothing else in the library imports this subpackage."""
import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks then need no copy of this package on the executors
