"""Lodestar: corpus building, retrieval and retrieval evaluation as Spark jobs.

Every operator is a plain ``DataFrame -> DataFrame`` function.  Many documents,
many chunks and many queries go through one plan at a time.
"""

import sys

from pyspark import cloudpickle

# The few functions that run inside Python workers travel with the plan, so executors need
# no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
