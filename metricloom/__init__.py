"""Event and anomaly analytics on Spark.

Every operator is a function from DataFrame to DataFrame with keyword options and no
global state; fitted objects (scalers, forests, boosters) keep a small, bounded
parameter set on the driver and apply it as a projection.
"""

import sys

from pyspark import cloudpickle

# Functions travel to Python workers by value: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
