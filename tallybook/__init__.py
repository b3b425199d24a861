"""Ledger analytics on Spark: statements in, categorized ledgers and grounded answers out."""

import sys

from pyspark import cloudpickle

# The few functions that run in Python workers travel with the query, so executors
# need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
