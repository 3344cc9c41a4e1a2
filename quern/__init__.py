"""Quern: a PySpark-native engine for hybrid text retrieval and its evaluation.

Functions that run on executors are shipped by value, so that executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
