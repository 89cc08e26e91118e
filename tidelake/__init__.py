"""Spark-first analytics over tables of sequential decisions, and tools for training corpora."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with their code: workers needn't have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
