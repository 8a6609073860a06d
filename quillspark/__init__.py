"""A Spark engine for document collections: search, retrieval, evidence, analysis and ingestion as DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions of this package that run on executors travel with the task, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
