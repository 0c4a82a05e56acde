"""Trend operators."""

import math

from ..functions import series as s
from ..plans.expr import NULL, ROW, E, cum, flag, fn, roll, scan, where
from .cycle import flexed
from .registry import operator


def moves(high: E, low: E, drift: int = 1) -> tuple[E, E]:
    """Directional movement up and down."""
    up, dn = high - high.lag(drift), low.lag(drift) - low
    return where((up > dn) & (up > 0.0), up, 0.0), where((dn > up) & (dn > 0.0), dn, 0.0)


def rising(x: E, n: int = 1, strict: bool = False, percent: float | None = None, sign: int = 1) -> E:
    if strict:
        out = None
        for i in range(n):
            a, b = x.lag(i), x.lag(i + 1)
            if percent:
                b = b * (1 + sign * 0.01 * percent)
            step = a > b if sign > 0 else a < b
            out = step if out is None else out & step
        return out
    base = x.lag(n) * (1 + sign * 0.01 * percent) if percent else x.lag(n)
    return x > base if sign > 0 else x < base


@operator("trend")
def adx(high, low, close, length=14, signal_length=None, adxr_length=2, scalar=100, mamode="rma", drift=1):
    sig = signal_length or length
    k = scalar / s.atr(high, low, close, length)
    pos, neg = moves(high, low, drift)
    dmp, dmn = k * s.ma(mamode, pos, length), k * s.ma(mamode, neg, length)
    dx = scalar * (dmp - dmn).abs() / (dmp + dmn)
    a = s.ma(mamode, dx, sig)
    return {f"ADX_{sig}": a, f"ADXR_{sig}_{adxr_length}": 0.5 * (a + a.lag(adxr_length)), f"DMP_{length}": dmp, f"DMN_{length}": dmn}


@operator("trend")
def alphatrend(open_, high, low, close, volume=None, src="close", length=14, multiplier=1, threshold=50, lag=2, mamode="sma"):
    width = multiplier * s.atr(high, low, close, length, mamode)
    source = {"open": open_, "high": high, "low": low, "close": close}[src]
    strength = s.rsi_like(source, length) if volume is None else money_flow(high, low, close, volume, length)
    at = scan("alpha_trend", [low - width, high + width, flag(strength >= float(threshold))])[0]
    tail = f"_{length}_{multiplier}_{threshold}"
    return {f"ALPHAT{tail}": at, f"ALPHATl{tail}_{lag}": at.lag(lag)}


def money_flow(high: E, low: E, close: E, volume: E, n: int, drift: int = 1, strict: bool = False) -> E:
    tp = s.hlc3(high, low, close)
    raw, past = tp * volume, tp.lag(drift)
    known = ~fn("isnull", past)
    pos = where(tp > past, raw, 0.0)
    neg = where(known & (tp < past if strict else tp <= past), raw, 0.0)
    p, q = (roll("sum", where(known, x, NULL), n) for x in (pos, neg))
    return 100.0 * p / (p + q + s.EPS)


def runs(fast: E, slow: E, n: int, long: bool) -> E:
    if long:
        return rising(fast, n) & (rising(slow, n, sign=-1) | rising(slow, n))
    return rising(fast, n, sign=-1) & (rising(slow, n) | rising(slow, n, sign=-1))


@operator("trend")
def amat(close, fast=8, slow=21, lookback=2, mamode="ema"):
    f, sl = s.ma(mamode, close, fast), s.ma(mamode, close, slow)
    return {f"AMAT{mamode[0]}_{k}_{fast}_{slow}_{lookback}": flag(runs(f, sl, lookback, k == "LR")) for k in ("LR", "SR")}


@operator("trend")
def aroon(high, low, length=14, scalar=100):
    up = scalar * (1.0 - roll("argmax", high, length + 1) / length)
    dn = scalar * (1.0 - roll("argmin", low, length + 1) / length)
    return {f"AROOND_{length}": dn, f"AROONU_{length}": up, f"AROONOSC_{length}": up - dn}


@operator("trend")
def chop(high, low, close, length=14, atr_length=1, ln=False, scalar=100):
    total = roll("sum", s.atr(high, low, close, atr_length), length)
    span = roll("max", high, length) - roll("min", low, length)
    return {f"CHOP{'ln' if ln else ''}_{length}_{atr_length}_{scalar}": scalar * (fn("ln", total) - fn("ln", span)) / math.log(length)}


@operator("trend")
def cksp(high, low, close, p=10, x=3, q=20, mamode="rma"):
    width = x * s.atr(high, low, close, p, mamode)
    return {f"CKSPl_{p}_{x}_{q}": roll("max", roll("max", high, p) - width, q), f"CKSPs_{p}_{x}_{q}": roll("min", roll("min", low, p) + width, q)}


@operator("trend")
def decay(close, length=1, mode="linear"):
    kind = "linear" if mode == "linear" else "exp"
    if kind == "linear":
        # Falling by 1/n a row from the highest so far is a running maximum of values raised by their row.
        return {f"LDECAY_{length}": fn("smax", cum("max", close + ROW / float(length)) - ROW / float(length), 0)}
    return {f"EXPDECAY_{length}": scan("ratchet_decay", [close], length=length)[0]}


def _monotone(name: str, sign: int):
    def build(close, length=1, strict=False, percent=None):
        return {f"{'S' if strict else ''}{name}{'p' if percent else ''}_{length}{f'_{0.01 * percent}' if percent else ''}": flag(rising(close, length, strict, percent, sign))}

    operator("trend", "increasing" if sign > 0 else "decreasing")(build)


_monotone("INC", 1)
_monotone("DEC", -1)


@operator("trend")
def dm(high, low, length=14, mamode="rma", drift=1, seed=None):
    """seed="sma": the averages begin with the mean of the first `length` moves."""
    average = (lambda x: s.seeded_changes(x, length, drift)) if seed == "sma" else lambda x: s.ma(mamode, x, length)
    pos, neg = moves(high, low, drift)
    return {f"DMP_{length}": average(pos), f"DMN_{length}": average(neg)}


@operator("trend")
def dpo(close, length=20, centered=False):
    t = length // 2 + 1
    if centered:
        return {f"DPO_{length}": E("lag", (close.lag(t) - s.sma(close, length),), (-t,))}
    return {f"DPO_{length}": close - s.sma(close, length).lag(t)}


@operator("trend")
def ht_trendline(close, prenan=63):
    return {"HT_TL": scan("trendline", [close], prenan=prenan)[0]}


@operator("trend")
def long_run(fast_, slow_, length=2):
    return {f"LR_{length}": flag(runs(fast_, slow_, length, True))}


@operator("trend")
def short_run(fast_, slow_, length=2):
    return {f"SR_{length}": flag(runs(fast_, slow_, length, False))}


@operator("trend")
def psar(high, low, close=None, af0=0.02, max_af=0.2):
    names = [f"PSAR{k}_{af0}_{max_af}" for k in ("l", "s", "af", "r")]
    return dict(zip(names, scan("parabolic", [high, low, NULL if close is None else close], 4, af0=af0, max_af=max_af), strict=True))


@operator("trend")
def qstick(open_, close, length=10, mamode="sma"):
    return {f"QS_{length}": s.ma(mamode, s.gap(close, open_), length)}


@operator("trend")
def rwi(high, low, close, length=14, mamode="rma"):
    width = s.atr(high, low, close, length, mamode) * math.sqrt(length)
    return {f"RWIh_{length}": (high - low.lag(length)) / width, f"RWIl_{length}": (high.lag(length) - low) / width}


@operator("trend")
def trendflex(close, length=20, smooth=20, alpha=0.04, pi=3.14159, sqrt2=1.414):
    return {f"TRENDFLEX_{length}_{smooth}_{alpha}": flexed(close, length, smooth, alpha, pi, sqrt2, False)}


@operator("trend")
def ttm_trend(high, low, close, length=6):
    mean = s.sma(s.hl2(high, low), length)
    return {f"TTM_TRND_{length}": where(fn("isnull", mean), NULL, where(close > mean, 1, -1))}


@operator("trend")
def vhf(close, length=28, drift=1):
    span = (roll("max", close, length) - roll("min", close, length)).abs()
    return {f"VHF_{length}": span / roll("sum", close.diff(drift).abs(), length)}


@operator("trend")
def vortex(high, low, close, length=14, drift=1):
    total = roll("sum", s.true_range(high, low, close, drift), length)
    p, m = (high - low.lag(drift)).abs(), (low - high.lag(drift)).abs()
    return {f"VTXP_{length}": roll("sum", p, length) / total, f"VTXM_{length}": roll("sum", m, length) / total}


@operator("trend")
def zigzag(high, low, legs=10, deviation=5.0):
    """Swing, value and deviation at the bar from which a pivot is known, half a window after it: nothing repaints."""
    half = legs // 2
    size = 2 * half + 1
    # A pivot is the window's extreme in its middle; it becomes known with the window's last bar.
    is_low, is_high = low.lag(half) <= roll("min", low, size), high.lag(half) >= roll("max", high, size)
    tail = f"_{deviation}%_{legs}"
    out = scan("swings", [low.lag(half), high.lag(half), flag(is_low), flag(is_high)], 3, deviation=deviation)
    return dict(zip([f"ZIGZAG{k}{tail}" for k in ("s", "v", "d")], out, strict=True))
