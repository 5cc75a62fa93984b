"""probity: account scoring and text analytics as Spark jobs."""
import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value, so that a driver that was started with a
# changed sys.path needs no copy of the package on every machine.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
