"""Quantitative-assay analytics on Spark DataFrames.

Every operator takes plain long tables (sample x feature x value) and returns
plain long tables, so that Catalyst sees one declarative plan from scan to sink.
"""

import sys

from pyspark import cloudpickle

# The few functions that run inside tasks travel with the plan, so executors
# need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
