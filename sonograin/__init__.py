"""Listening-history analytics on Spark."""

import sys

from pyspark import cloudpickle

# Executors need not have this package: what tasks use of it is sent along.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
