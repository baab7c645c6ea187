"""Training-data operators over a corpus of documents, pages and vectors.

Nothing else in the library imports this subpackage; ``__spark_entry__``
registers its queries when it is present.
"""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value, so executors need no
# copy of the package on their own path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
