"""tidegrid: event studies and data audits over very large sets of time series, on Spark.

Every operator takes and returns DataFrames. The identity of a series is a set of key
columns, so one job serves one series or many thousands, and no operator puts a whole
series into one task: see ``tidegrid.functions.segments``.
"""

import sys

from pyspark import cloudpickle

# Kernels travel to the tasks by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from tidegrid.params import StudyParams  # noqa: E402

__all__ = ["StudyParams"]
