"""Early-warning analytics for market risk on Spark."""

import sys

from pyspark import cloudpickle

# Python functions of this package travel to the workers with the job, so that a cluster needs no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
