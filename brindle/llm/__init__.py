"""Operators for preparing training corpora. Nothing outside imports this."""

import sys

from pyspark import cloudpickle

# Functions of these modules travel to the workers by value, so executors need
# no copy of the repository.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
