"""Corpus retrieval and analytics as PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

# functions go to executors with their code, so that the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
