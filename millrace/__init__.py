"""Metadata-driven table operations on Spark DataFrames.

Every operator takes DataFrames (or Columns) and returns DataFrames (or Columns);
nothing is collected to the driver unless the docstring says so.
"""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks are shipped with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
