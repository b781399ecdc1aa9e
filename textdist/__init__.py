"""textdist: compare text collections as distributions, on Spark.

Every operator takes DataFrames and returns DataFrames.
"""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value, so executors do not
# need this package on their own import path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
