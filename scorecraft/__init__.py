"""scorecraft: evaluation analytics for structured-extraction outputs on Spark.

Every operator takes and returns DataFrames; nothing is collected to the
driver except results whose size is bounded by the number of models or
categories.
"""

from scorecraft.session import build_session, checkpoint_dir, prepare_session

__all__ = ["build_session", "checkpoint_dir", "prepare_session"]

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value: executors need no copy
# of the package on their own path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
