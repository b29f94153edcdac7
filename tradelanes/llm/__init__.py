"""Operators for preparing training text.

Nothing else in the library imports this package. Its functions travel to the
executors by value, so that a worker needs Python and the public packages only.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
