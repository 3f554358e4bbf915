"""Functional-imaging analytics as Spark plans.

The package is shipped to Python workers by value, so a cluster needs no
installed copy on its executors.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
