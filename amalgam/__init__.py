"""Evidence-aware record fusion on Spark: DataFrame-first operators for
normalising, validating, resolving, fusing and evaluating conflicting records."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their code, so executors
# need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
