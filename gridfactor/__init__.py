"""Grid factorization and table analytics on Spark DataFrames.

Functions of this package are pickled by value: executors need not see the driver's Python path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
