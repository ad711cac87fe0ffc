"""Operators that prepare and check training data."""

import sys

from pyspark import cloudpickle

# The functions of this package travel with their tasks, so workers need no installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
