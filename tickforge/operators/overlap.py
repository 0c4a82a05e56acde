"""Overlap operators: averages and channels on the price scale."""

import math

from ..functions import series as s
from ..plans.expr import NULL, E, cum, dot, fn, roll, scan, where
from .registry import operator


@operator("overlap")
def alligator(close, jaw=13, teeth=8, lips=5):
    tail = f"_{jaw}_{teeth}_{lips}"
    return {f"AG{k}{tail}": s.smma(close, n) for k, n in (("j", jaw), ("t", teeth), ("l", lips))}


@operator("overlap")
def alma(close, length=9, sigma=6.0, dist_offset=0.85):
    k, w = math.floor(dist_offset * (length - 1)), length / sigma
    return {f"ALMA_{length}_{sigma}_{dist_offset}": dot(close, s.normed([math.exp(-0.5 * ((i - k) / w) ** 2) for i in range(length)]))}


def _simple(kind: str, f, default: int = 10) -> None:
    def build(close, length=default):
        return {f"{kind.upper()}_{length}": f(close, length)}

    operator("overlap", kind)(build)


_DEFAULTS = {
    "fwma": 10, "pwma": 10, "rma": 10, "sinwma": 14, "sma": 10, "swma": 10, "trima": 10, "midpoint": 2, "vidya": 14,
}
for _kind, _default in _DEFAULTS.items():
    _simple(_kind, s.MODES[_kind], _default)


@operator("overlap")
def dema(close, length=10, seed=None):
    return {f"DEMA_{length}": s.dema(close, length, seed)}


@operator("overlap")
def tema(close, length=10, seed=None):
    return {f"TEMA_{length}": s.tema(close, length, seed)}


@operator("overlap")
def ema(close, length=10, presma=True):
    return {f"EMA_{length}": s.ema(close, length, presma)}


@operator("overlap")
def wma(close, length=10, asc=True):
    return {f"WMA_{length}": s.wma(close, length, asc)}


@operator("overlap")
def smma(close, length=7, mamode="sma"):
    return {f"SMMA_{length}": s.smma(close, length)}


@operator("overlap")
def t3(close, length=10, a=0.7, seed=None):
    return {f"T3_{length}_{a}": s.t3(close, length, a, seed)}


@operator("overlap")
def hilo(high, low, close, high_length=13, low_length=21, mamode="sma"):
    top, floor = s.ma(mamode, high, high_length), s.ma(mamode, low, low_length)
    up, down = close > top.lag(), close < floor.lag()
    tail = f"_{high_length}_{low_length}"
    long, short = where(up, floor, NULL), where(up, NULL, where(down, top, NULL))
    side = where(up, 1, where(down, -1, NULL)).ffill()
    line = where(up, floor, where(down, top, NULL)).ffill()
    held = ~(up | down)
    return {f"HILO{tail}": line, f"HILOl{tail}": where(held & side.same(1.0), line, where(held & side.same(-1.0), line, long)), f"HILOs{tail}": where(held & ~fn("isnull", side), line, short)}


@operator("overlap")
def hl2(high, low):
    return {"HL2": s.hl2(high, low)}


@operator("overlap")
def hlc3(high, low, close):
    return {"HLC3": s.hlc3(high, low, close)}


@operator("overlap")
def ohlc4(open_, high, low, close):
    return {"OHLC4": 0.25 * (open_ + high + low + close)}


@operator("overlap")
def wcp(high, low, close):
    return {"WCP": (high + low + 2.0 * close) / 4.0}


@operator("overlap")
def hma(close, length=10, mamode="wma"):
    if mamode not in ("ema", "sma", "wma"):
        raise ValueError("hma takes ema, sma or wma")
    return {f"HMA{'' if mamode == 'wma' else mamode[0]}_{length}": s.hma(close, length, mamode)}


@operator("overlap")
def hwma(close, na=0.2, nb=0.1, nc=0.1):
    return {f"HWMA_{na}_{nb}_{nc}": scan("holt_winters", [close], 2, na=na, nb=nb, nc=nc)[0]}


@operator("overlap")
def ichimoku(high, low, close, tenkan=9, kijun=26, senkou=52, include_chikou=False):
    """The spans stand where they were projected from; plans.tables gives the future rows. Chikou looks ahead."""
    middle = lambda n: 0.5 * (roll("max", high, n) + roll("min", low, n))
    ts, ks = middle(tenkan), middle(kijun)
    out = {f"ISA_{tenkan}": (0.5 * (ts + ks)).lag(kijun - 1), f"ISB_{kijun}": middle(senkou).lag(kijun - 1), f"ITS_{tenkan}": ts, f"IKS_{kijun}": ks}
    return out | ({f"ICS_{kijun}": E("lag", (close,), (1 - kijun,))} if include_chikou else {})


@operator("overlap")
def jma(close, length=7, phase=0.0):
    return {f"JMA_{length}_{phase}": s.jurik(close, length, phase)}


@operator("overlap")
def kama(close, length=10, fast=2, slow=30, mamode="sma", drift=1):
    fr, sr = 2 / (fast + 1), 2 / (slow + 1)
    er = s.gap(close, close.lag(length)).abs() / roll("sum", s.gap(close, close.lag(drift)).abs(), length)
    share = er * (fr - sr) + sr
    return {f"KAMA_{length}_{fast}_{slow}": scan("adaptive", [close, share * share, s.ma(mamode, close, length)], start=length - 1)[0]}


@operator("overlap")
def linreg(close, length=14, angle=False, degrees=False, intercept=False, r=False, slope=False, tsf=False):
    m = dot(close, s.slope_weights(length))
    b = s.line(close, length, 0)
    if slope:
        return {f"LINREGm_{length}": m}
    if intercept:
        return {f"LINREGb_{length}": b}
    if angle:
        theta = fn("atan", m)
        return {f"LINREGa_{length}": theta * (180 / math.pi) if degrees else theta}
    if r:
        return {f"LINREGr_{length}": s.correlation(close, length)}
    return {f"LINREG_{length}": s.line(close, length, length + 1 if tsf else length)}


@operator("overlap")
def mama(close, fastlimit=0.5, slowlimit=0.05, prenan=3):
    m, f = scan("mesa", [close], 2, fastlimit=fastlimit, slowlimit=slowlimit, prenan=prenan)
    return {f"MAMA_{fastlimit}_{slowlimit}": m, f"FAMA_{fastlimit}_{slowlimit}": f}


@operator("overlap")
def mcgd(close, length=10, c=1):
    return {f"MCGD_{length}": scan("mcginley", [close], length=length, c=c)[0]}


@operator("overlap")
def midprice(high, low, length=2):
    return {f"MIDPRICE_{length}": 0.5 * (roll("min", low, length) + roll("max", high, length))}


@operator("overlap")
def pivots(open_, high, low, close, ts, method="traditional", anchor="D"):
    """Levels from the last full period (D, W, M or Y), which hold through the next. Nothing of the present period
    is used, row by row."""
    period = E("period", (ts,), (anchor,))
    new = ~period.same(period.lag())
    first = fn("isnull", period.lag())
    last = lambda x: where(new & ~first, x.lag(), NULL).ffill()
    o, h, l, c = last(cum("first", open_, period)), last(cum("max", high, period)), last(cum("min", low, period)), last(close)
    d, third = h - l, (h + l + c) / 3.0
    tail = lambda levels: {f"PIVOTS_{method[:5].upper() if method != 'traditional' else 'TRAD'}_{anchor}_{k}": v for k, v in levels.items()}
    if method == "camarilla":
        out = {"P": third} | {f"S{i}": c - 1.1 / x * d for i, x in ((1, 12), (2, 6), (3, 4), (4, 2))} | {f"R{i}": c + 1.1 / x * d for i, x in ((1, 12), (2, 6), (3, 4), (4, 2))}
    elif method == "classic":
        out = {"P": third, "S1": 2.0 * third - h, "S2": third - d, "S3": third - 2.0 * d, "S4": third - 3.0 * d, "R1": 2.0 * third - l, "R2": third + d, "R3": third + 2.0 * d, "R4": third + 3.0 * d}
    elif method == "demark":
        x = where(o.same(c), h + l + 2.0 * c, where(c > o, 2.0 * h + l + c, h + 2.0 * l + c))
        out = {"P": 0.25 * x, "S1": 0.5 * x - h, "R1": 0.5 * x - l}
    elif method == "fibonacci":
        out = {"P": third} | {f"S{i}": third - x * d for i, x in ((1, 0.382), (2, 0.618), (3, 1.0))} | {f"R{i}": third + x * d for i, x in ((1, 0.382), (2, 0.618), (3, 1.0))}
    elif method == "woodie":
        p = 0.25 * (h + l + 2.0 * open_)
        s3, r3 = l - 2.0 * (h - p), h + 2.0 * (p - l)
        out = {"P": p, "S1": 2.0 * p - h, "S2": p - d, "S3": s3, "S4": s3 - d, "R1": 2.0 * p - l, "R2": p + d, "R3": r3, "R4": r3 + d}
    elif method == "traditional":
        s3, r3 = 2.0 * third - (2.0 * h - l), 2.0 * third + (h - 2.0 * l)
        out = {"P": third, "S1": 2.0 * third - h, "S2": third - d, "S3": s3, "S4": s3, "R1": 2.0 * third - l, "R2": third + d, "R3": r3, "R4": r3}
    else:
        raise ValueError(f"no such method: {method}")
    return tail(out)


@operator("overlap")
def ssf(close, length=20, everget=False, pi=3.14159, sqrt2=1.414):
    return {f"SSF{'e' if everget else ''}_{length}": s.ssf(close, length, everget, pi, sqrt2)}


@operator("overlap")
def ssf3(close, length=20, pi=3.14159, sqrt3=1.732):
    a = math.exp(-pi / length)
    b, c = 2 * a * math.cos(-pi * sqrt3 / length), a * a
    d2, d3, d4 = b + c, -c * (1 + b), c * c
    return {f"SSF3_{length}": scan("three_pole", [close], d=(1 - d2 - d3 - d4, d2, d3, d4))[0]}


@operator("overlap")
def supertrend(high, low, close, length=7, atr_length=None, multiplier=3.0, atr_mamode="rma"):
    mid, width = s.hl2(high, low), multiplier * s.atr(high, low, close, atr_length or length, atr_mamode)
    names = [f"SUPERT{k}_{length}_{multiplier}" for k in ("", "d", "l", "s")]
    return dict(zip(names, scan("super_trend", [close, mid - width, mid + width], 4, length=length), strict=True))


@operator("overlap")
def zlma(close, length=10, mamode="ema"):
    return {f"ZL_{mamode.upper()}_{length}": s.zlma(close, length, mamode)}
