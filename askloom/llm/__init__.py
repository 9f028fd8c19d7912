"""Operators of a training-data pipeline. Nothing outside this package imports it."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the tasks by value, so that executors need
# not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
