"""weirflow: ordered dataflow operators, stateful analytics and large-scale data preparation on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions that run on executors travel with the plan, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
