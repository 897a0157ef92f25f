"""Document ingestion, retrieval, conversation analytics and training-data operators on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors inside the tasks, so that nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
