"""Operators of a training-data pipeline. Functions that run in tasks are sent by value, so executors need no copy."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
