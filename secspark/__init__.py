"""Security-log detection engine built on Spark DataFrames."""

import sys as _sys

# Python workers may not have this package on their path (a cluster, or a
# driver started from another folder).  Functions from it that Spark ships to
# workers -- the PowerShell decode pandas UDF, the streaming state function --
# are therefore pickled by value instead of by module reference.
try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except (ImportError, AttributeError, ValueError):  # pragma: no cover - older pickler
    pass
