"""Deterministic text retrieval, record lineage and corpus preparation on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Executors get the functions themselves, so workers need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
