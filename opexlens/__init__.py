"""opexlens: operations-cost analytics on Spark.

The package is pickled *by value* into Python tasks (UDF / applyInPandas /
mapInPandas closures), so executors need numpy, pandas and pyarrow but
not this package installed.
"""

from __future__ import annotations

import sys

try:
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle without the hook
    pass

__all__ = ["operators", "sources", "functions", "plans", "streaming", "session", "schema"]
