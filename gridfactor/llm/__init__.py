"""Training-data operators: extraction, near-duplicate detection, mixing, sharding and the rest.

Nothing else in the library imports this subpackage.  Its functions are pickled by value, so that
executors that can't see the driver's Python path still run them.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
