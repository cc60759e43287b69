"""Ledgerloom: Spark-native accounting analytics over ledger, price and text tables."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value, so that a cluster
# needs no copy of it on its workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
