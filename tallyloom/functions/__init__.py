"""Functions of the reconciliation library."""

import sys

from pyspark import cloudpickle

# Executors get the functions that they run with each task and don't need the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
