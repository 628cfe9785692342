"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage.

Functions that run in Python workers are shipped by value, so workers need not have the library installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
