"""Operators of a training-data pipeline (deduplication, filtering, mixing, packing, sharding).

Each module holds one operator with its own general interface; ``queries`` applies them, with
production parameters, to the given tables.  Nothing else in the package imports this one.
"""

import sys

from pyspark import cloudpickle

# functions of this package travel to the executors by value, so they need not have it installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
