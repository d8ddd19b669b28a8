"""scholarlens: Spark-native analytics over collections of documents."""

import sys

from pyspark import cloudpickle

# functions of this package travel to executors by value, so that they needn't have it installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
