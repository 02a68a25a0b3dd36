"""Training-data operators: filters, near-duplicate search, mixing and scoring of document tables.

Nothing else in the library imports this subpackage.  Functions that run in Python
workers are pickled by value, so executors need no copy of the package.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
