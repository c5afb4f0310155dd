"""Operators of a training-data pipeline over saved articles, list pages and log lines.

Nothing else in the library imports this package. Its functions are pickled by
value, so executors need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
