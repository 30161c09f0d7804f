"""Operators for training-data pipelines over a table of documents.

Nothing else in the library imports this package. Python functions that run in
tasks are pickled by value, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
