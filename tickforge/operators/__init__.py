"""The catalogue of operators, by category."""

from . import candle, cycle, momentum, overlap, performance, statistics, trend, volatility, volume  # noqa: F401
