"""Shot-boundary analytics on PySpark: frames and videos as DataFrames, scenes as a query."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"
info = {"name": "shotline", "version": __version__, "description": "Shot-boundary analytics on PySpark", "credits": {"algorithm": "Xvid motion estimation"}}

# Functions that executors run travel with the plan, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
