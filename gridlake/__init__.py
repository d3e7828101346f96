"""Gridded scientific data on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# Send the few Python kernels to executors by value, so that the package need not be
# installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
