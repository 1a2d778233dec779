"""sulatan: script transliteration and handwriting-recognition data on Spark.

Every public function takes and returns Spark ``Column`` or ``DataFrame``
objects, so a caller composes them into one lazily planned job.
"""

__version__ = "0.1.0"

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Python functions that run inside tasks travel with their code, so executors
# need no copy of this package on their path.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
