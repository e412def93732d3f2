"""fieldlens: image-dataset building and model evaluation as Spark DataFrame operators."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

__version__ = "0.1.0"

# functions sent to executors travel by value, so executors need not have this package installed
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
