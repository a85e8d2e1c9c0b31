"""Video statistics on Spark: sparse ingestion, rollups, aligned curves, reconciliation, health."""

import sys

from pyspark import cloudpickle

# The few Python steps travel with their task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
