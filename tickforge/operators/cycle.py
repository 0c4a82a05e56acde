"""Cycle operators."""

import math

from ..plans.expr import ROW, E, scan, where
from .registry import operator


@operator("cycle")
def ebsw(close, length=40, bars=10, initial_version=False):
    return {f"EBSW_{length}_{bars}": scan("sinewave", [close], length=length, bars=bars, initial=initial_version)[0]}


def flexed(close: E, length: int, smooth: int, alpha: float, pi: float, sqrt2: float, slope: bool) -> E:
    ratio = 2 * sqrt2 / smooth
    a = math.exp(-pi * ratio)
    b = 2 * a * math.cos(180 * ratio)
    f = scan("smoother", [close], a=a, b=b, c=a * a - b + 1, passes=False)[0]
    return where(ROW > float(length), scan("flex", [f], n=length, alpha=alpha, slope=slope)[0], E("lit", (), (None,)))


@operator("cycle")
def reflex(close, length=20, smooth=20, alpha=0.04, pi=3.14159, sqrt2=1.414):
    return {f"REFLEX_{length}_{smooth}_{alpha}": flexed(close, length, smooth, alpha, pi, sqrt2, True)}
