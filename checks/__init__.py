"""Queries over the driver's tables and the SQL that must give the same answers."""

import sys

from pyspark import cloudpickle

# Python tasks carry the code they need, wherever the queries are started from.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
