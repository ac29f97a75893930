"""Operators for training-data pipelines; nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# tasks get the functions themselves, so that workers need no copy of the library on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])
