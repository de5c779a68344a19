"""tidefolio: portfolio and return-series analytics as Spark jobs over long tables."""

import sys

from pyspark import cloudpickle

# Grouped NumPy helpers travel with the closure, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
