"""Operators of a training-data pipeline over documents, pages and conversations.

Functions that run inside tasks travel by value, so that executors need the
interpreter and its libraries but not this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
