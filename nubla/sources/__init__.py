"""Sources and sinks. Their functions are sent to Python workers by value, so that executors need not have the package."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
