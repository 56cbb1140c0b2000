"""Storeloom: the data work of an online shop's back office, as Spark jobs."""

import sys

from pyspark import cloudpickle

# The few functions that run inside Python workers travel with the job, so executors need
# no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
