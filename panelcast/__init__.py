"""Spark-native cleaning, profiling, feature building, forecasting and evaluation of time series."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
