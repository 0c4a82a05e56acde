"""Momentum operators."""

import math

from ..functions import series as s
from ..functions.signals import signals
from ..plans.expr import NULL, ROW, E, col, dot, flag, fn, roll, scan, where
from .registry import operator
from .volatility import bands, rvi_by


def _with_signals(out: dict[str, E], wanted: bool, xa, xb, xseries, cross_values: bool) -> dict[str, E]:
    """An operator's column, and if wanted its signals against two levels and a series (a column's name)."""
    if not wanted:
        return out
    ((name, x),) = out.items()
    other = None if xseries is None else xseries if isinstance(xseries, E) else col(xseries)
    return out | signals(name, x, xa, xb, cross_values, other, xseries if isinstance(xseries, str) else "SERIES")


@operator("momentum")
def ao(high, low, fast=5, slow=34):
    m = s.hl2(high, low)
    return {f"AO_{fast}_{slow}": s.sma(m, fast) - s.sma(m, slow)}


@operator("momentum")
def apo(close, fast=12, slow=26, mamode="sma"):
    return {f"APO_{fast}_{slow}": s.ma(mamode, close, fast) - s.ma(mamode, close, slow)}


@operator("momentum")
def bias(close, length=26, mamode="sma"):
    return {f"BIAS_{mamode.upper()}_{length}": close / s.ma(mamode, close, length) - 1.0}


@operator("momentum")
def bop(open_, high, low, close, scalar=1):
    return {"BOP": scalar * s.gap(close, open_) / s.gap(high, low)}


@operator("momentum")
def brar(open_, high, low, close, length=26, scalar=100, drift=1):
    total = lambda x: roll("sum", x, length)
    pc = close.lag(drift)
    up = lambda x: where(fn("isnull", x), NULL, fn("gmax", x, 0))
    return {f"AR_{length}": scalar * total(s.gap(high, open_)) / total(s.gap(open_, low)), f"BR_{length}": scalar * total(up(high - pc)) / total(up(pc - low))}


@operator("momentum")
def cci(high, low, close, length=14, c=0.015):
    tp = s.hlc3(high, low, close)
    return {f"CCI_{length}_{c}": (tp - s.sma(tp, length)) / (c * roll("mad", tp, length))}


@operator("momentum")
def cfo(close, length=9, scalar=100):
    return {f"CFO_{length}": scalar * (close - s.line(close, length, length + 1)) / close}


@operator("momentum")
def cg(close, length=10):
    return {f"CG_{length}": -(dot(close, range(1, length + 1)) / roll("sum", close, length))}


@operator("momentum")
def cmo(close, length=14, scalar=100, talib=True, drift=1, seed=None):
    """seed="sma": the averages begin with the mean of the first `length` changes."""
    d = close.diff(drift)
    up, dn = where(d < 0.0, 0.0, d), where(d > 0.0, 0.0, d).abs()
    average = (lambda x: s.seeded_changes(x, length, drift)) if seed == "sma" else lambda x: s.rma(x, length)
    p, q = (average(x) if talib else roll("sum", x, length) for x in (up, dn))
    return {f"CMO_{length}": scalar * (p - q) / (p + q)}


@operator("momentum")
def coppock(close, length=10, fast=11, slow=14):
    return {f"COPC_{fast}_{slow}_{length}": s.wma(s.move(close, fast, 100.0) + s.move(close, slow, 100.0), length)}


@operator("momentum")
def crsi(close, rsi_length=3, streak_length=2, rank_length=100, scalar=100, drift=1):
    streak = fn("coalesce", fn("sign", close.diff()), 0)
    # The first row has no change: it is not less than any.
    rank = where(fn("isnull", close), NULL, roll("prank", fn("coalesce", s.move(close, 1), 1e300), rank_length + 1))
    price, moves = (s.rsi_like(x, n, drift=drift, scalar=scalar) for x, n in ((close, rsi_length), (streak, streak_length)))
    return {f"CRSI_{rsi_length}_{streak_length}_{rank_length}": (price + moves + rank) / 3.0}


@operator("momentum")
def cti(close, length=12):
    return {f"CTI_{length}": s.correlation(close, length)}


@operator("momentum")
def er(close, length=10, drift=1, signal_indicators=False, xa=80, xb=20, xseries=None, cross_values=False):
    out = {f"ER_{length}": close.diff(length).abs() / roll("sum", close.diff(drift).abs(), length)}
    return _with_signals(out, signal_indicators, xa, xb, xseries, cross_values)


@operator("momentum")
def eri(high, low, close, length=13):
    m = s.ema(close, length)
    return {f"BULLP_{length}": high - m, f"BEARP_{length}": low - m}


@operator("momentum")
def exhc(close, length=4, cap=13, show_all=True):
    d = close.diff(length)
    # A run's length is the rows since the last bar that broke it.
    since = lambda run: fn("smin", ROW - fn("coalesce", where(run, NULL, ROW).ffill(), 0), cap if cap > 0 else 1e9)
    dn, up = since(d < 0.0), since(d > 0.0)
    if not show_all:
        dn, up = (where((x >= 6.0) & (x <= 9.0), x, 0.0) for x in (dn, up))
    a = "a" if show_all else ""
    return {f"EXHC_DN{a}": dn, f"EXHC_UP{a}": up}


@operator("momentum")
def fisher(high, low, length=9, signal=1):
    m = s.hl2(high, low)
    top, floor = roll("max", m, length), roll("min", m, length)
    position = (m - floor) / fn("smax", top - floor, 0.001) - 0.5
    y = scan("fisher_transform", [position], length=length)[0]
    return {f"FISHERT_{length}_{signal}": y, f"FISHERTs_{length}_{signal}": y.lag(signal)}


@operator("momentum")
def inertia(close, high=None, low=None, length=20, rvi_length=14, scalar=100, refined=False, thirds=False, mamode="ema"):
    mode, x = rvi_by(close, high, low, rvi_length, scalar, refined, thirds, mamode)
    return {f"INERTIA{mode}_{length}_{rvi_length}": s.linreg(x, length)}


def percent_k(high: E, low: E, close: E, n: int) -> E:
    floor = roll("min", low, n)
    return 100.0 * (close - floor) / s.gap(roll("max", high, n), floor)


@operator("momentum")
def kdj(high, low, close, length=9, signal=3):
    k = s.adjusted(percent_k(high, low, close, length), signal)
    d = s.adjusted(k, signal)
    return {f"K_{length}_{signal}": k, f"D_{length}_{signal}": d, f"J_{length}_{signal}": 3.0 * k - 2.0 * d}


@operator("momentum")
def kst(close, signal=9, roc1=10, roc2=15, roc3=20, roc4=30, sma1=10, sma2=10, sma3=10, sma4=15):
    y = NULL
    for i, (r, n) in enumerate(((roc1, sma1), (roc2, sma2), (roc3, sma3), (roc4, sma4)), 1):
        part = float(i) * s.sma(s.move(close, r, 100.0), n)
        y = part if i == 1 else y + part
    y = 100.0 * y
    return {f"KST_{roc1}_{roc2}_{roc3}_{roc4}_{sma1}_{sma2}_{sma3}_{sma4}": y, f"KSTs_{signal}": s.sma(y, signal)}


def seeded_from(x: E, n: int, first: int) -> E:
    """An EMA over a series from row `first` on, seeded with the mean of its first n values."""
    at = float(first + n - 1)
    return s.ema(where(ROW < at, NULL, where(ROW.same(at), roll("mean", x, n), x)), n, presma=False)


@operator("momentum")
def macd(close, fast=12, slow=26, signal=9, asmode=False, signal_indicators=False):
    """signal_indicators: crossings of zero by the histogram, and whether the line is above zero."""
    fast, slow = min(fast, slow), max(fast, slow)
    m = s.ema(close, fast) - s.ema(close, slow)
    sig = seeded_from(m, signal, slow)
    if asmode:
        m = m - sig
        sig = seeded_from(m, signal, slow + signal - 1)
    tail = f"{'AS' if asmode else ''}_{fast}_{slow}_{signal}"
    h = f"MACD{'AS' if asmode else ''}h_{fast}_{slow}_{signal}"
    out = {f"MACD{tail}": m, h: m - sig, h.replace("h_", "s_", 1): sig}
    return out | signals(h, m - sig, 0, None) | signals(f"MACD{tail}", m, 0, None, False) if signal_indicators else out


@operator("momentum")
def mom(close, length=10):
    return {f"MOM_{length}": close.diff(length)}


@operator("momentum")
def pgo(high, low, close, length=14):
    return {f"PGO_{length}": (close - s.sma(close, length)) / s.ema(s.atr(high, low, close, length), length)}


@operator("momentum")
def ppo(close, fast=12, slow=26, signal=9, scalar=100, mamode="sma"):
    f, sl = s.ma(mamode, close, fast), s.ma(mamode, close, slow)
    y = scalar * (f - sl) / sl
    sig = s.ema(y, signal)
    tail = f"_{fast}_{slow}_{signal}"
    return {f"PPO{tail}": y, f"PPOh{tail}": y - sig, f"PPOs{tail}": sig}


@operator("momentum")
def psl(close, open_=None, length=12, scalar=100, drift=1):
    d = fn("sign", close - open_ if open_ is not None else close.diff(drift))
    return {f"PSL_{length}": scalar * roll("sum", flag(d > 0.0), length) / length}


@operator("momentum")
def qqe(close, length=14, smooth=5, factor=4.236, mamode="ema", drift=1):
    r = s.ma(mamode, s.rsi_like(close, length), smooth)
    n = 2 * length - 1
    width = factor * s.ema(s.ema(r.diff(drift).abs(), n), n)
    y, long, short = scan("qqe_bands", [r, r - width, r + width], 3)
    m = "" if mamode == "ema" else mamode[0]
    tail = f"{m}_{length}_{smooth}_{factor}"
    return {f"QQE{tail}": y, f"QQE{tail}_RSI{m.upper()}MA": r, f"QQEl{tail}": long, f"QQEs{tail}": short}


@operator("momentum")
def roc(close, length=10, scalar=100):
    return {f"ROC_{length}": s.move(close, length, float(scalar))}


@operator("momentum")
def rsi(close, length=14, scalar=100, mamode="rma", drift=1, seed=None, signal_indicators=False, xa=80, xb=20, xseries=None, cross_values=False):
    """seed="sma": the averages begin with the mean of the first `length` changes."""
    out = {f"RSI_{length}": s.rsi_like(close, length, mamode, drift, scalar, seed)}
    return _with_signals(out, signal_indicators, xa, xb, xseries, cross_values)


@operator("momentum")
def rsx(close, length=14, signal_indicators=False, xa=80, xb=20, xseries=None, cross_values=False):
    out = {f"RSX_{length}": scan("noise_free_rsi", [close], length=length)[0]}
    return _with_signals(out, signal_indicators, xa, xb, xseries, cross_values)


@operator("momentum")
def rvgi(open_, high, low, close, length=14, swma_length=4):
    y = roll("sum", s.swma(s.gap(close, open_), swma_length), length) / (roll("sum", s.swma(s.gap(high, low), swma_length), length) + 1e-10)
    return {f"RVGI_{length}_{swma_length}": y, f"RVGIs_{length}_{swma_length}": s.swma(y, swma_length)}


@operator("momentum")
def slope(close, length=1, as_angle=False, to_degrees=False):
    m = close.diff(length) / length
    if not as_angle:
        return {f"SLOPE_{length}": m}
    a = fn("atan", m)
    return {f"ANGLE{'d' if to_degrees else 'r'}_{length}": a * (180 / math.pi) if to_degrees else a}


@operator("momentum")
def smc(open_, high, low, close, abr_length=14, close_length=50, vol_length=20, percent=5, vol_ratio=1.5, mamode="sma"):
    """Gaps between bars two apart against the range, carried forward; nothing is filled from later bars."""
    abr = roll("max", high, abr_length) - roll("min", low, abr_length)
    top, bottom = low.lag(2) - high, low - high.lag(2)
    tp, bp = 100.0 * top / abr, 100.0 * bottom / abr
    span = high - low + s.EPS
    tail = f"_{abr_length}_{close_length}_{vol_length}_{percent}"
    return {
        f"SMChv{tail}": flag(span > vol_ratio * s.ma(mamode, span, vol_length)), f"SMCbf{tail}": flag((bottom > 0.0) & (bp > 1.0)), f"SMCbi{tail}": bottom.ffill(), f"SMCbp{tail}": bp.ffill(),
        f"SMCtf{tail}": flag((top > 0.0) & (tp > 1.0)), f"SMCti{tail}": top.ffill(), f"SMCtp{tail}": tp.ffill(),
    }


def true_strength(close: E, fast: int, slow: int, signal: int, scalar: float, mamode: str = "ema") -> tuple[E, E]:
    d = close.diff()
    y = scalar * s.ema(s.ema(d, slow), fast) / (s.ema(s.ema(d.abs(), slow), fast) + 1e-10)
    return y, s.ma(mamode, y, signal)


@operator("momentum")
def smi(close, fast=5, slow=20, signal=5, scalar=1):
    y, sig = true_strength(close, fast, slow, signal, float(scalar))
    tail = f"_{fast}_{slow}_{signal}_{scalar}"
    return {f"SMI{tail}": y, f"SMIs{tail}": sig, f"SMIo{tail}": y - sig}


def _momentum(close: E, high: E, low: E, mom_length: int, mom_smooth: int, kc_length: int, mamode: str, lazybear: bool) -> E:
    if lazybear:
        mid = 0.25 * (roll("max", high, kc_length) + roll("min", low, kc_length)) + 0.5 * s.sma(close, kc_length)
        return s.linreg(close - mid, kc_length)
    return s.ma("ema" if mamode == "ema" else "sma", close.diff(mom_length), mom_smooth)


@operator("momentum")
def squeeze(high, low, close, bb_length=20, bb_std=2.0, kc_length=20, kc_scalar=1.5, mom_length=12, mom_smooth=6, tr=True, mamode="sma", lazybear=False):
    bl, _, bu = bands(close, bb_length, bb_std, bb_std, mamode, 1)
    width = kc_scalar * s.ma(mamode, s.true_range(high, low, close) if tr else high - low, kc_length)
    mid = s.ma(mamode, close, kc_length)
    on, off = (bl > mid - width) & (bu < mid + width), (bl < mid - width) & (bu > mid + width)
    name = f"SQZ{'' if tr else 'hlr'}_{bb_length}_{bb_std}_{kc_length}_{kc_scalar}{'_LB' if lazybear else ''}"
    return {name: _momentum(close, high, low, mom_length, mom_smooth, kc_length, mamode, lazybear), "SQZ_ON": flag(on), "SQZ_OFF": flag(off), "SQZ_NO": flag(~(on | off))}


@operator("momentum")
def squeeze_pro(high, low, close, bb_length=20, bb_std=2.0, kc_length=20, kc_scalar_narrow=1, kc_scalar_normal=1.5, kc_scalar_wide=2, mom_length=12, mom_smooth=6, tr=True, mamode="sma"):
    if not kc_scalar_wide > kc_scalar_normal > kc_scalar_narrow:
        raise ValueError("the widths must fall from wide over normal to narrow")
    bl, _, bu = bands(close, bb_length, bb_std, bb_std, mamode, 1)
    unit, mid = s.ma(mamode, s.true_range(high, low, close) if tr else high - low, kc_length), s.ma(mamode, close, kc_length)
    inside = lambda k: (bl > mid - k * unit) & (bu < mid + k * unit)
    wide, normal, narrow = inside(kc_scalar_wide), inside(kc_scalar_normal), inside(kc_scalar_narrow)
    off = (bl < mid - kc_scalar_wide * unit) & (bu > mid + kc_scalar_wide * unit)
    name = f"SQZPRO{'' if tr else 'hlr'}_{bb_length}_{bb_std}_{kc_length}_{kc_scalar_wide}_{kc_scalar_normal}_{kc_scalar_narrow}"
    return {
        name: _momentum(close, high, low, mom_length, mom_smooth, kc_length, mamode, False), "SQZPRO_ON_WIDE": flag(wide), "SQZPRO_ON_NORMAL": flag(normal), "SQZPRO_ON_NARROW": flag(narrow), "SQZPRO_OFF": flag(off),
        "SQZPRO_NO": flag(~(wide | off)),
    }


@operator("momentum")
def stc(close, tc_length=10, fast=12, slow=26, factor=0.5):
    x = s.ema(close, fast) - s.ema(close, slow)
    y, k = scan("schaff", [x, roll("min", x, tc_length), roll("max", x, tc_length)], 2, length=tc_length, factor=factor)
    first = float(max(tc_length, fast, slow))
    tail = f"_{tc_length}_{fast}_{slow}_{factor}"
    return {f"STC{tail}": where(ROW < first, NULL, y), f"STCmacd{tail}": x, f"STCstoch{tail}": where(ROW < first, NULL, k)}


@operator("momentum")
def stoch(high, low, close, k=14, d=3, smooth_k=3, mamode="sma"):
    a = s.ma(mamode, percent_k(high, low, close, k), smooth_k)
    b = s.ma(mamode, a, d)
    tail = f"_{k}_{d}_{smooth_k}"
    return {f"STOCHk{tail}": a, f"STOCHd{tail}": b, f"STOCHh{tail}": a - b}


@operator("momentum")
def stochf(high, low, close, k=14, d=3, mamode="sma"):
    a = percent_k(high, low, close, k)
    return {f"STOCHFk_{k}_{d}": a, f"STOCHFd_{k}_{d}": s.ma(mamode, a, d)}


@operator("momentum")
def stochrsi(close, length=14, rsi_length=14, k=3, d=3, mamode="sma"):
    r = s.rsi_like(close, rsi_length)
    a = s.ma(mamode, percent_k(r, r, r, length), k)
    tail = f"_{length}_{rsi_length}_{k}_{d}"
    return {f"STOCHRSIk{tail}": a, f"STOCHRSId{tail}": s.ma(mamode, a, d)}


@operator("momentum")
def tmo(open_, close, tmo_length=14, calc_length=5, smooth_length=3, momentum=False, normalize=False, exclusive=True, mamode="ema"):
    """The close against the last opens. normalize divides by their number, into -1 to 1; not exclusive, the present bar
    counts as one of them and the lookback is shorter by it."""
    total, opens = NULL, tmo_length if exclusive else max(1, tmo_length - 1)
    for j in range(1, opens + 1):
        part = fn("sign", close - open_.lag(j))
        total = part if j == 1 else total + part
    total = total / float(opens) if normalize else total
    main = s.ma(mamode, s.ma(mamode, total, calc_length), smooth_length)
    sig = s.ma(mamode, main, smooth_length)
    tail = f"_{tmo_length}_{calc_length}_{smooth_length}"
    m = (main.diff(tmo_length), sig.diff(tmo_length)) if momentum else (E("lit", (), (0.0,)),) * 2
    return {f"TMO{tail}": main, f"TMOs{tail}": sig, f"TMOM{tail}": m[0], f"TMOMs{tail}": m[1]}


@operator("momentum")
def trix(close, length=30, signal=9, scalar=100, drift=1):
    y = s.move(s.ema(s.ema(s.ema(close, length), length), length), drift, float(scalar))
    return {f"TRIX_{length}_{signal}": y, f"TRIXs_{length}_{signal}": s.sma(y, signal)}


@operator("momentum")
def tsi(close, fast=13, slow=25, signal=13, scalar=100, mamode="ema"):
    y, sig = true_strength(close, fast, slow, signal, float(scalar), mamode)
    return {f"TSI_{fast}_{slow}_{signal}": y, f"TSIs_{fast}_{slow}_{signal}": sig}


@operator("momentum")
def uo(high, low, close, fast=7, medium=14, slow=28, fast_w=4.0, medium_w=2.0, slow_w=1.0, drift=1):
    pc = close.lag(drift)
    floor, top = fn("gmin", low, pc), fn("gmax", high, pc)
    known = lambda x: where(fn("isnull", pc), NULL, x)
    bp, tr = known(close - floor), known(top - floor)
    part = lambda n: roll("sum", bp, n) / roll("sum", tr, n)
    return {f"UO_{fast}_{medium}_{slow}": 100.0 * (fast_w * part(fast) + medium_w * part(medium) + slow_w * part(slow)) / (fast_w + medium_w + slow_w)}


@operator("momentum")
def willr(high, low, close, length=14):
    floor = roll("min", low, length)
    return {f"WILLR_{length}": 100.0 * ((close - floor) / (roll("max", high, length) - floor) - 1.0)}
