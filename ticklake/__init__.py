"""ticklake: ordered market time-series analytics on Spark.

Bars (OHLCV per symbol) in, indicator / cleaning / feature columns out.
Every operator is a DataFrame transformation; per-symbol ordered work is
planned over time segments of each symbol (see ``plans.frame``) so one very
large symbol is still split over many tasks.
"""

import sys as _sys

from pyspark import cloudpickle as _cp

# Python workers get this package's functions by value, so a session
# created elsewhere (a cluster, the driver harness) needs no install step.
_cp.register_pickle_by_value(_sys.modules[__name__])

from ticklake.session import get_spark, checkpoint_dir  # noqa: E402,F401

__all__ = ["get_spark", "checkpoint_dir"]
