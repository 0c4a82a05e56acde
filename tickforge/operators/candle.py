"""Candle operators."""

from ..functions.series import sma
from ..plans.expr import ROW, E, ewm, flag, fn, roll, where
from .registry import operator


@operator("candle")
def cdl_doji(open_, high, low, close, length=10, factor=10, scalar=100):
    hit = (close - open_).abs() < 0.01 * factor * sma((high - low).abs(), length)
    return {f"CDL_DOJI_{length}_{0.01 * factor}": where(hit, scalar, 0)}


def _inside(high: E, low: E) -> E:
    return (high < high.lag()) & (low > low.lag())


@operator("candle")
def cdl_inside(open_, high, low, close, scalar=100):
    return {"CDL_INSIDE": flag(_inside(high, low)) * float(scalar)}


@operator("candle")
def cdl_pattern(open_, high, low, close, name="all", scalar=100):
    """The patterns that have a definition of their own here: doji and inside."""
    known = {"doji": lambda: next(iter(cdl_doji(open_, high, low, close, scalar=scalar).values())), "inside": lambda: flag(_inside(high, low)) * scalar}
    wanted = known if name == "all" else [name] if isinstance(name, str) else name
    missing = [n for n in wanted if n not in known]
    if missing:
        raise ValueError(f"no such pattern: {', '.join(missing)}")
    names = {"doji": "CDL_DOJI_10_0.1", "inside": "CDL_INSIDE"}
    return {names[n]: known[n]() for n in wanted}


@operator("candle")
def cdl_z(open_, high, low, close, length=30, ddof=1):
    out = {}
    for name, x in (("open", open_), ("high", high), ("low", low), ("close", close)):
        out[f"{name}_Z_{length}_{ddof}"] = (x - sma(x, length)) / roll("std", x, length, ddof=ddof)
    return out


@operator("candle")
def ha(open_, high, low, close):
    c = 0.25 * (open_ + high + low + close)
    # The first open is the raw bar's middle; from then on it follows the candle's own open and close.
    o = ewm(where(ROW.same(1.0), 0.5 * (open_ + close), c.lag()), 0.5)
    return {"HA_open": o, "HA_high": fn("gmax", o, high, c), "HA_low": fn("gmin", o, low, c), "HA_close": c}
