"""Spark-native passage retrieval: corpus ingest, vector search, keyword search,
query-log classification and response assembly, all as DataFrame -> DataFrame jobs."""

import sys as _sys

__version__ = "0.1.0"

# Python functions that run on executors (mapInPandas kernels) are pickled by value, so
# workers need no installed copy of this package.
try:
    from pyspark import cloudpickle as _cloudpickle
    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001 - older cloudpickle: fall back to shipping the package
    pass
