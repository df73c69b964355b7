"""Operators of a training-data pipeline: near and exact duplicates, packing, mixing, extraction, filters.

Tasks get the functions of this package by value, so executors need only the
libraries they use, not the repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
