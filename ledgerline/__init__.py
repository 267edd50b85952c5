"""Self-service business analytics on Spark: profile, clean, chart, ask, forecast, detect, train, report.

Every operator takes a DataFrame and returns a lazy DataFrame; see README.md for the map.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python tasks carry the package's functions with them; a cluster needs no separate install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
