"""Operators of training-data pipelines: deduplication, scans, tokenization, language models, archives, search.

Nothing else in the library imports this package. Kernels travel to the workers by value, so executors need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
