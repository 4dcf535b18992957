"""Spark-native retrieval analytics and training-data operators."""

import sys

from pyspark import cloudpickle

# Python workers needn't have this package: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
