"""fourfold: one set of records read four ways (tables, keys, links, vectors) on PySpark."""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Python kernels travel to executors by value: a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
