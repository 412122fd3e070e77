"""Structural-variant analytics and corpus operators, expressed as Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with what they use, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
