"""Operators that prepare text, vectors and conversations for model training. Nothing outside this package imports it.

Functions that run in tasks are sent by value, so executors need numpy and pyarrow but not this library on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
