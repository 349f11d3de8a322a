"""Document intelligence on Spark: collected notices in, traceable scored records out."""

import sys

from pyspark import cloudpickle

# The few Python functions travel to the executors by value, so a cluster needs no install step.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
