"""Performance operators."""

from ..plans.expr import cum, fn
from .registry import operator


@operator("performance")
def drawdown(close, with_max=False):
    top = cum("max", close)
    out = {"DD": top - close, "DD_PCT": 1.0 - close / top, "DD_LOG": fn("ln", top) - fn("ln", close)}
    return out | ({"max_DD": cum("max", top - close)} if with_max else {})


@operator("performance")
def log_return(close, length=1, cumulative=False):
    base = cum("first", close) if cumulative else close.lag(length)
    return {f"{'CUM' if cumulative else ''}LOGRET_{length}": fn("ln", close / base)}


@operator("performance")
def percent_return(close, length=1, cumulative=False):
    base = cum("first", close) if cumulative else close.lag(length)
    return {f"{'CUM' if cumulative else ''}PCTRET_{length}": close / base - 1.0}
