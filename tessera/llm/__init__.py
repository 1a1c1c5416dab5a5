"""Training-data operators: dedup, decontamination, extraction, scoring, mixing, token output.

Each module is one operator. Nothing outside this subpackage imports it.
Task functions are pickled by value, so executors need the third-party
libraries only, not an installed copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
