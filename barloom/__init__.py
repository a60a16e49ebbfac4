"""Panel and factor analytics on the public PySpark DataFrame API."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python workers get the few functions they run by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
