"""Cross-matching and quality checks of positional tables on the sphere, as DataFrame plans.

Functions that run in Spark's Python workers are pickled by value, so executors need no copy of the
repository on their import path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
