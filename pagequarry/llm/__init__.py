"""Operators of a training-data pipeline. Nothing outside this subpackage imports it but the entry
module, which does without it if it is not there.

What runs in Python workers travels to them by value, so a cluster without this package can run it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
