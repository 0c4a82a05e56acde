"""Volume operators."""

from ..functions import series as s
from ..plans.expr import NULL, ROW, E, cum, flag, fn, roll, scan, where
from .registry import operator
from .trend import money_flow, runs


def location(high: E, low: E, close: E, open_: E | None = None) -> E:
    """Where the close stands in the bar's range, from -1 to 1; or the body's share of it."""
    return (2.0 * close - (high + low) if open_ is None else s.gap(close, open_)) / s.gap(high, low)


@operator("volume")
def ad(high, low, close, volume, open_=None):
    return {"AD" if open_ is None else "ADo": cum("sum", location(high, low, close, open_) * volume)}


@operator("volume")
def adosc(high, low, close, volume, open_=None, fast=3, slow=10):
    a = cum("sum", location(high, low, close, open_) * volume)
    return {f"ADOSC_{fast}_{slow}": s.ema(a, fast) - s.ema(a, slow)}


def balance(close: E, volume: E) -> E:
    return cum("sum", s.signed(close, 1) * volume)


@operator("volume")
def aobv(close, volume, fast=4, slow=12, max_lookback=2, min_lookback=2, mamode="ema", run_length=2):
    o = balance(close, volume)
    f, sl, m = s.ma(mamode, o, fast), s.ma(mamode, o, slow), mamode[0]
    return {
        "OBV": o, f"OBV_min_{min_lookback}": roll("min", o, min_lookback), f"OBV_max_{max_lookback}": roll("max", o, max_lookback), f"OBV{m}_{fast}": f, f"OBV{m}_{slow}": sl,
        f"AOBV_LR_{run_length}": flag(runs(f, sl, run_length, True)), f"AOBV_SR_{run_length}": flag(runs(f, sl, run_length, False)),
    }


@operator("volume")
def cmf(high, low, close, volume, open_=None, length=20):
    return {f"CMF_{length}": roll("sum", location(high, low, close, open_) * volume, length) / roll("sum", volume, length)}


@operator("volume")
def efi(close, volume, length=13, mamode="ema", drift=1):
    return {f"EFI_{length}": s.ma(mamode, close.diff(drift) * volume, length)}


@operator("volume")
def eom(high, low, close, volume, length=14, divisor=100000000, drift=1):
    distance = s.hl2(high, low) - s.hl2(high.lag(drift), low.lag(drift))
    return {f"EOM_{length}_{divisor}": s.sma(distance / (volume / divisor / s.gap(high, low)), length)}


@operator("volume")
def kvo(high, low, close, volume, fast=34, slow=55, signal=13, mamode="ema"):
    sv = volume * s.signed(s.hlc3(high, low, close), -1)
    k = s.ma(mamode, sv, fast) - s.ma(mamode, sv, slow)
    tail = f"_{fast}_{slow}_{signal}"
    return {f"KVO{tail}": k, f"KVOs{tail}": late(k, signal, max(fast, slow), mamode)}


def late(x: E, n: int, first: int, mode: str = "ema") -> E:
    """An average of a series that begins at row `first`, seeded with its own first n values."""
    if mode != "ema":
        return s.ma(mode, x, n)
    at = float(first + n - 1)
    seeded = where(ROW < at, NULL, where(ROW.same(at), roll("mean", x, n), x))
    return s.ema(seeded, n, presma=False)


@operator("volume")
def mfi(high, low, close, volume, length=14, drift=1, strict=False):
    return {f"MFI_{length}": money_flow(high, low, close, volume, length, drift, strict)}


@operator("volume")
def nvi(close, volume, length=1, initial=1000):
    fell = volume < volume.lag()
    return {f"NVI_{length}": initial + cum("sum", where(fell, fn("coalesce", s.move(close, length, 100.0), 0), 0.0))}


@operator("volume")
def obv(close, volume):
    return {"OBV": balance(close, volume)}


@operator("volume")
def pvi(close, volume, length=255, initial=100, mamode="ema", overlay=False):
    ratio = where(volume > volume.lag(), close / close.lag(), 1.0)
    y = scan("multiplied", [ratio, close if overlay else initial])[0]
    return {"PVI": y, f"PVI{mamode[0]}_{length}": s.ma(mamode, y, length)}


@operator("volume")
def pvo(volume, fast=12, slow=26, signal=9, scalar=100):
    f, sl = s.ema(volume, fast), s.ema(volume, slow)
    y = scalar * (f - sl) / sl
    sig = s.ema(y, signal)
    tail = f"_{fast}_{slow}_{signal}"
    return {f"PVO{tail}": y, f"PVOh{tail}": y - sig, f"PVOs{tail}": sig}


@operator("volume")
def pvol(close, volume, signed=False):
    y = close * volume
    return {"PVOL": y * s.signed(close, 1) if signed else y}


@operator("volume")
def pvr(close, volume, drift=1):
    c, v = (fn("coalesce", x.diff(drift), 0) for x in (close, volume))
    return {"PVR": where(c >= 0.0, where(v >= 0.0, 1, 2), where(v >= 0.0, 3, 4))}


@operator("volume")
def pvt(close, volume, drift=1):
    return {"PVT": cum("sum", s.move(close, drift, 100.0) * volume)}


@operator("volume")
def tsv(close, volume, length=18, signal=10, mamode="sma", drift=1):
    y = roll("sum", volume * close.diff(drift), length)
    sig = s.ma(mamode, y, signal)
    tail = f"_{length}_{signal}"
    return {f"TSV{tail}": y, f"TSVs{tail}": sig, f"TSVr{tail}": y / sig}


@operator("volume")
def vhm(volume, length=610, std_length=None, mamode="sma"):
    n = std_length or length
    return {f"VHM_{length}{f'_{n}' if n != length else ''}": (volume - s.ma(mamode, volume, length)) / roll("std", volume, n, ddof=0)}


@operator("volume")
def vwap(high, low, close, volume, ts, anchor="D", bands=()):
    period = E("period", (ts,), (anchor,))
    tp = s.hlc3(high, low, close)
    total = cum("sum", volume, period)
    mean = cum("sum", tp * volume, period) / total
    out = {f"VWAP_{anchor}": mean}
    if bands:
        dev = fn("sqrt", cum("sum", volume * (tp - mean) * (tp - mean), period) / total)
        for b in bands:
            out |= {f"VWAP_{anchor}_L_{b}": mean - b * dev, f"VWAP_{anchor}_U_{b}": mean + b * dev}
    return out


@operator("volume")
def vwma(close, volume, length=10):
    return {f"VWMA_{length}": s.sma(close * volume, length) / s.sma(volume, length)}


@operator("volume")
def vp(close, volume, width=10):
    """The fullest price range of the volume profile as of each row, approximately: for studies and streams. The whole
    series' profile is plans.tables.vp."""
    names = ("low_price", "mean_price", "high_price", "pos_volume", "neg_volume", "neut_volume", "total_volume")
    out = scan("online_profile", [close, volume, s.signed(close, 1.0)], 7, width=width)
    return {f"VP_{width}_{k}": v for k, v in zip(names, out, strict=True)}
