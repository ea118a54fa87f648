"""millrace: event analytics and corpus preparation expressed as Spark DataFrame plans.

Functions that run in Python workers are shipped by value, so executors need
numpy, pandas and pyarrow but no copy of this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
