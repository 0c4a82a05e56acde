"""Statistics operators."""

import math

from ..functions.series import sma
from ..plans.expr import ROW, cum, fn, roll
from .registry import operator


@operator("statistics")
def entropy(close, length=10, base=2.0):
    p = close / roll("sum", close, length)
    return {f"ENTP_{length}": roll("sum", -(p * fn("ln", p) / math.log(base)), length)}


@operator("statistics")
def kurtosis(close, length=30):
    return {f"KURT_{length}": roll("kurt", close, length)}


@operator("statistics")
def mad(close, length=30):
    return {f"MAD_{length}": roll("mad", close, length)}


@operator("statistics")
def median(close, length=30):
    return {f"MEDIAN_{length}": roll("quantile", close, length, q=0.5)}


@operator("statistics")
def quantile(close, length=30, q=0.5):
    return {f"QTL_{length}_{q}": roll("quantile", close, length, q=q)}


@operator("statistics")
def skew(close, length=30):
    return {f"SKEW_{length}": roll("skew", close, length)}


@operator("statistics")
def stdev(close, length=30, ddof=1):
    return {f"STDEV_{length}": roll("std", close, length, ddof=ddof)}


@operator("statistics")
def variance(close, length=30, ddof=1):
    return {f"VAR_{length}": roll("var", close, length, ddof=ddof)}


@operator("statistics")
def zscore(close, length=30, std=1.0):
    return {f"ZS_{length}": (close - sma(close, length)) / (std * roll("std", close, length))}


@operator("statistics")
def tos_stdevall(close, stds=(1, 2, 3), ddof=1):
    """The least-squares line of all rows up to each, and bands of their standard deviation: for studies and streams.
    The whole series' line is plans.tables.tos_stdevall."""
    x = close - cum("first", close)  # sums stay small
    n, sx, sxx, six = ROW, cum("sum", x), cum("sum", x * x), cum("sum", x * ROW)
    si, sii = n * (n + 1.0) * 0.5, n * (n + 1.0) * (2.0 * n + 1.0) / 6.0
    slope = (n * six - si * sx) / (n * sii - si * si)
    line = cum("first", close) + sx / n + slope * (n - si / n)
    dev = fn("sqrt", fn("gmax", sxx - sx * sx / n, 0.0) / (n - float(ddof)))
    out = {"TOS_STDEVALL_LR": line}
    for k in sorted(stds):
        out |= {f"TOS_STDEVALL_L_{k}": line - float(k) * dev, f"TOS_STDEVALL_U_{k}": line + float(k) * dev}
    return out
