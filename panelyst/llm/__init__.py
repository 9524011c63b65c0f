"""Operators for large training-text corpora.

Nothing else in the library imports this subpackage. Every operator is ``DataFrame -> DataFrame``; ``catalogue`` holds
the registered queries.
"""

import sys

from pyspark import cloudpickle

# The functions that run in Python workers travel with the plans, so executors need the libraries but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
