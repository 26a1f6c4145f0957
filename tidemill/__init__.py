"""Table preparation, profiling, modelling and log analytics as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions that run in Python tasks travel with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
