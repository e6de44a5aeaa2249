"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage.

Python kernels are shipped to executors by value, so a cluster needs no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
