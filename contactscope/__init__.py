"""Order and contact analytics as Spark DataFrame operators.

Every operator takes DataFrames and column names and returns a lazy DataFrame.
Only the estimators in ``operators.models`` run jobs while they are being built.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions of this package travel to the executors with their code, which need no copy of it.
register_pickle_by_value(sys.modules[__name__])
