"""spanlake: question-answering data preparation, span decoding and scoring on Spark.

Every public function takes and returns DataFrames or Columns; nothing is collected
to the driver. See README.md for the operator map.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# The few Arrow/pandas UDFs travel to the Python workers by value, so executors need
# no installed copy of this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

from spanlake.session import get_spark, shared_dir  # noqa: E402

__all__ = ["get_spark", "shared_dir"]
