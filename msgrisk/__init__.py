"""Message-risk analytics on Spark: every public operator maps DataFrame to DataFrame."""

import sys

from pyspark import cloudpickle

# Scorers and state functions travel with the tasks that run them, so executors
# need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
