"""Correspondence analytics on Spark: letters, registers, graphs, passages and search as DataFrame operations.

The package's Python functions are pickled by value, so a job runs on executors that don't have the package installed.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
