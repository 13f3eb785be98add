"""plexus: a PySpark-native engine for voxel volumes and vessel networks."""

import sys

from pyspark import cloudpickle

# Kernels travel to the executors by value, so that executors need no copy of
# this package on their own import path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
