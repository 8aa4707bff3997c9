"""bowline: bag-of-words text embeddings as Spark DataFrame operators."""

import sys as _sys

try:  # ship this package's functions to Python workers by value, so executors
    # need no copy of the package on their path
    from pyspark import cloudpickle as _cp
    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle
    pass
