"""Sequence-graph analytics on Spark: a bidirected graph with embedded paths as DataFrames."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions of this package that run in Python workers are shipped whole, so that the workers need not have it installed.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
