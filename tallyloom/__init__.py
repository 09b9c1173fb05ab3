"""Evaluation, batch-apply, chunking and ticket-threading jobs on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the Python workers with their code, so that a cluster
# needs nothing installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
