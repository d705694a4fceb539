"""Operators: indicators by category, signals, metrics, cleaning, features."""

from ticklake.operators import registry  # noqa: F401
from ticklake.operators import (candles, momentum, overlap, performance, statistics, trend,  # noqa: F401
                                volatility, volume)
from ticklake.operators import state  # noqa: F401,E402
from ticklake.operators import custom  # noqa: F401,E402
from ticklake.operators import signals  # noqa: F401,E402
