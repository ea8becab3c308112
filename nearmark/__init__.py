"""nearmark - evaluating vector search with Spark DataFrames.

Corpora and query sets are DataFrames; ground truth, retrieval scores, run
reports, drift splits, table replay and synthetic corpora are Spark jobs over
them.
"""

import sys

from pyspark import cloudpickle

from nearmark.schema import METRICS, VectorDataset

# Code used inside tasks travels with the task, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["METRICS", "VectorDataset"]
__version__ = "0.1.0"
