"""Operators for large-scale training-data pipelines.

Nothing else in the package imports this subpackage. Its functions are sent to Python workers by value, so that
executors need not have the package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
