"""strandmill: a Spark-native engine for functional-genomics style tables."""

import sys

from pyspark import cloudpickle

# functions that run in Python workers travel with their code, so the package
# need not be installed on every node
cloudpickle.register_pickle_by_value(sys.modules[__name__])
