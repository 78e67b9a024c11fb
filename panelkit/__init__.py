"""panelkit: panel-data and cohort-model operators on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Arrow kernels defined in this package travel to the executors by value, so a cluster needs
# no installed copy of it on the worker nodes.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
