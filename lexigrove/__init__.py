"""Lexicon, embedding, clustering and cluster-evaluation jobs on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Task functions travel by value, so executors need numpy and pyarrow but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
