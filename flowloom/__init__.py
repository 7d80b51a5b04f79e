"""flowloom: network-flow-table and flow-graph analytics, planned by Catalyst."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the task, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
