"""Operators that prepare text for training language models. Nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors with their code, so that it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
