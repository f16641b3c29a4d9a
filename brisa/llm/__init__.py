"""Operators for preparing training data: texts, tokens, embeddings and web archives."""

import sys

from pyspark import cloudpickle

# Functions of this package travel with the tasks, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
