"""Operators for preparing training data, as Spark jobs over documents, vectors and conversations."""

import sys

from pyspark import cloudpickle

# Task functions travel by value, so executors need the libraries but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
