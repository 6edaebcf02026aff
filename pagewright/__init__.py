"""Document-intelligence and training-data operators, written as Spark plans."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python workers get the functions themselves, so the package need not be installed on executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
