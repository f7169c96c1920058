"""A PySpark-native analytics engine with PostgreSQL-flavoured semantics."""

import sys

from pyspark import cloudpickle

from brindle.session import get_spark, load

# functions go to the executors by value, so that they need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["get_spark", "load"]
