"""Volatility operators."""

from ..functions import series as s
from ..plans.expr import NULL, E, flag, fn, roll, scan, where
from .registry import operator


@operator("volatility")
def aberration(high, low, close, length=5, atr_length=15):
    a, z = s.atr(high, low, close, atr_length), s.sma(s.hlc3(high, low, close), length)
    tail = f"_{length}_{atr_length}"
    return {f"ABER_ZG{tail}": z, f"ABER_SG{tail}": z + a, f"ABER_XG{tail}": z - a, f"ABER_ATR{tail}": a}


@operator("volatility")
def accbands(high, low, close, length=20, c=4, mamode="sma"):
    r = c * s.gap(high, low) / (high + low)
    return {f"ACCBL_{length}": s.ma(mamode, low * (1.0 - r), length), f"ACCBM_{length}": s.ma(mamode, close, length), f"ACCBU_{length}": s.ma(mamode, high * (1.0 + r), length)}


@operator("volatility")
def atr(high, low, close, length=14, mamode="rma", percent=False, prenan=False):
    a = s.atr(high, low, close, length, mamode, prenan)
    return {f"ATR{mamode[0]}{'p' if percent else ''}_{length}": a * 100.0 / close if percent else a}


@operator("volatility")
def atrts(high, low, close, length=14, ma_length=20, k=3.0, mamode="ema", percent=False):
    width, mean = k * s.atr(high, low, close, length, mamode), s.ma(mamode, close, ma_length)
    y = scan("trailing_stop", [close, flag(close > mean), width], start=max(length, ma_length))[0]
    return {f"ATRTS{mamode[0]}{'p' if percent else ''}_{length}_{ma_length}_{k}": y * 100.0 / close if percent else y}


def bands(close: E, length: int, lower: float, upper: float, mamode: str, ddof: int) -> tuple[E, E, E]:
    dev, mid = roll("std", close, length, ddof=ddof), s.ma(mamode, close, length)
    return mid - lower * dev, mid, mid + upper * dev


@operator("volatility")
def bbands(close, length=5, lower_std=2.0, upper_std=2.0, ddof=1, mamode="sma"):
    low, mid, up = bands(close, length, lower_std, upper_std, mamode, ddof)
    width = s.gap(up, low)
    tail = f"_{length}_{lower_std}_{upper_std}"
    return {f"BBL{tail}": low, f"BBM{tail}": mid, f"BBU{tail}": up, f"BBB{tail}": 100.0 * width / mid, f"BBP{tail}": s.gap(close, low) / width}


@operator("volatility")
def chandelier_exit(high, low, close, high_length=22, low_length=22, atr_length=14, multiplier=2.0, mamode="rma", use_close=False):
    a = multiplier * s.atr(high, low, close, atr_length, mamode)
    top, floor = (close, close) if use_close else (high, low)
    long, short = roll("max", top, high_length, 1) - a, roll("min", floor, low_length, 1) + a
    above, below = close > long.lag(), close < short.lag()
    turn = where(above & ~below, 1, where(below & ~above, -1, NULL))  # beyond both, the side stays
    side = fn("coalesce", turn.ffill(), 1)
    tail = f"{'_CLOSE' if use_close else ''}_{high_length}_{low_length}_{atr_length}_{multiplier}"
    return {f"CHDLREXTl{tail}": long, f"CHDLREXTs{tail}": short, f"CHDLREXTd{tail}": side}


@operator("volatility")
def donchian(high, low, lower_length=20, upper_length=20):
    lo, up = roll("min", low, lower_length), roll("max", high, upper_length)
    return {f"DCL_{lower_length}_{upper_length}": lo, f"DCM_{lower_length}_{upper_length}": 0.5 * (lo + up), f"DCU_{lower_length}_{upper_length}": up}


@operator("volatility")
def hwc(close, scalar=1, channels=True, na=0.2, nb=0.1, nc=0.1, nd=0.1):
    y, dev = scan("holt_winters", [close], 2, na=na, nb=nb, nc=nc, nd=nd)
    low, up = y - scalar * dev, y + scalar * dev
    out = {f"HWM_{scalar}": y, f"HWL_{scalar}": low, f"HWU_{scalar}": up}
    return out | ({f"HWW_{scalar}": up - low, f"HWPCT_{scalar}": (close - low) / (up - low + s.EPS)} if channels else {})


@operator("volatility")
def kc(high, low, close, length=20, scalar=2, tr=True, mamode="ema"):
    width = s.true_range(high, low, close) if tr else high - low
    mid, band = s.ma(mamode, close, length), scalar * s.ma(mamode, width, length)
    tail = f"{mamode[0]}_{length}_{scalar}"
    return {f"KCL{tail}": mid - band, f"KCB{tail}": mid, f"KCU{tail}": mid + band}


@operator("volatility")
def massi(high, low, fast=9, slow=25):
    a = s.ema(s.gap(high, low), fast)
    return {f"MASSI_{fast}_{slow}": roll("sum", a / s.ema(a, fast), slow)}


@operator("volatility")
def natr(high, low, close, length=14, scalar=100, mamode="ema", prenan=False):
    return {f"NATR_{length}": scalar / close * s.atr(high, low, close, length, mamode, prenan)}


@operator("volatility")
def pdist(open_, high, low, close, drift=1):
    return {"PDIST": 2.0 * (high - low) + (open_ - close.lag(drift)).abs() - (close - open_).abs()}


def rvi_of(x: E, n: int, scalar: float, mamode: str, drift: int = 1) -> E:
    dev = roll("std", x, n)
    d = x.diff(drift)
    up, dn = where(d > 0.0, 1.0, 0.0), where(d < 0.0, 1.0, 0.0)
    p, q = s.ma(mamode, up * dev, n), s.ma(mamode, dn * dev, n)
    return scalar * p / (p + q + 1e-10)


def rvi_by(close: E, high: E | None, low: E | None, n: int, scalar: float, refined: bool, thirds: bool, mamode: str) -> tuple[str, E]:
    if (refined or thirds) and (high is None or low is None):
        raise ValueError("refined and thirds take high and low")
    if refined:
        return "r", 0.5 * (rvi_of(high, n, scalar, mamode) + rvi_of(low, n, scalar, mamode))
    if thirds:
        return "t", (rvi_of(high, n, scalar, mamode) + rvi_of(low, n, scalar, mamode) + rvi_of(close, n, scalar, mamode)) / 3.0
    return "", rvi_of(close, n, scalar, mamode)


@operator("volatility")
def rvi(close, high=None, low=None, length=14, scalar=100, refined=False, thirds=False, mamode="ema"):
    mode, x = rvi_by(close, high, low, length, scalar, refined, thirds, mamode)
    return {f"RVI{mode}_{length}": x}


@operator("volatility")
def thermo(high, low, length=20, long=2, short=0.5, mamode="ema", drift=1):
    th = fn("smax", (low.lag(drift) - low).abs(), (high - high.lag(drift)).abs())
    mean = s.ma(mamode, th, length)
    tail = f"_{length}_{long}_{short}"
    return {f"THERMO{tail}": th, f"THERMOma{tail}": mean, f"THERMOl{tail}": flag(th < mean * long), f"THERMOs{tail}": flag(th > mean * short)}


@operator("volatility")
def true_range(high, low, close, prenan=False, drift=1):
    return {f"TRUERANGE_{drift}": s.true_range(high, low, close, drift, prenan)}


@operator("volatility")
def ui(close, length=14, scalar=100, everget=False):
    top = roll("max", close, length)
    d = scalar * (close - top) / top
    mean = (s.sma(d * d, length) if everget else roll("sum", d * d, length)) / length
    return {f"UI{'e' if everget else ''}_{length}": fn("sqrt", mean)}
