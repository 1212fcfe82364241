"""Operators for preparing large text corpora. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with their code, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
