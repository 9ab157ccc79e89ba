"""plumbline: data-quality analytics as lazy Spark DataFrame operators."""
import sys

from pyspark import cloudpickle

# Helper functions travel to executors by value, so workers need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
