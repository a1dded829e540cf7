"""Operators for building training-data corpora.

Nothing else in the library imports this subpackage. Kernels that run inside
Python tasks are shipped by value, so executors need only the public libraries.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
