"""evenkeel: class-imbalance analytics as PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

# ship the small Arrow helpers inside the task, so executors need no installed copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])
