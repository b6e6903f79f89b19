"""quarry: corpus analytics as Spark jobs.

Every operator takes and returns DataFrames.  Python functions that run on
executors (``mapInPandas`` / ``applyInPandas`` bodies) are pickled by value,
so executors need no installed copy of this package.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

__version__ = "0.1.0"
