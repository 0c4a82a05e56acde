"""Signals: comparisons and crossings of series, and trades from trends."""

from ..plans.expr import NULL, E, e, flag, fn, where


def above(x: E, y) -> E:
    return flag(x >= e(y))


def below(x: E, y) -> E:
    return flag(x <= e(y))


def cross(x: E, y, over: bool = True, equal: bool = True) -> E:
    """1 where x crosses y: on its side now and strictly on the other before."""
    y = e(y)
    now = (x >= y if equal else x > y) if over else (x <= y if equal else x < y)
    before = y.lag() if y.op != "lit" else y
    return flag(now & (x.lag() < before if over else x.lag() > before))


def signals(name: str, x: E, xa: float | None = None, xb: float | None = None, cross_values: bool = True, xseries: E | None = None, other: str = "SERIES") -> dict[str, E]:
    """Columns of a series against two levels (crossings, or sides), and against another series."""
    tidy = lambda v: str(v).replace(".", "_")
    out: dict[str, E] = {}
    if xa is not None:
        out[f"{name}_XA_{tidy(xa)}" if cross_values else f"{name}_A_{tidy(xa)}"] = cross(x, xa) if cross_values else above(x, xa)
    if xb is not None:
        out[f"{name}_XB_{tidy(xb)}" if cross_values else f"{name}_B_{tidy(xb)}"] = cross(x, xb, over=False) if cross_values else below(x, xb)
    if xseries is not None:
        out |= {f"{name}_XA_{other}": cross(x, xseries), f"{name}_XB_{other}": cross(x, xseries, over=False)}
    return out


def tsignals(trend: E, drift: int = 1, offset: int = 0) -> dict[str, E]:
    """Entries and exits of a trend of 0 and 1. trade offset: 1 for backtests, 0 live."""
    trades = fn("coalesce", trend.diff(drift).lag(offset), 0)
    return {"TS_Trends": trend, "TS_Trades": trades, "TS_Entries": flag(trades > 0.0), "TS_Exits": where(trades < 0.0, trades.abs(), 0)}


def xsignals(x: E, xa, xb, above_first: bool = True, long: bool = True) -> dict[str, E]:
    """Trades between two crossings: in from one to the other; and the trend as a long and as a short position."""
    a, b = cross(x, xa, over=above_first), cross(x, xb, over=not above_first)
    trade = a - b
    state = fn("coalesce", where(trade.same(0.0), NULL, trade).ffill(), 0)
    trend = flag(state > 0.0) if long else flag(state <= 0.0)
    return tsignals(trend) | {"XS_LONG": trend, "XS_SHORT": 1.0 - trend}


def candle_color(open_: E, close: E) -> E:
    return where(close >= open_, 1, -1)


def real_body(open_: E, close: E) -> E:
    return (close - open_).abs()


def high_low_range(high: E, low: E) -> E:
    return high - low


def remap(x: E, low: float, high: float, to_low: float, to_high: float) -> E:
    return to_low + (to_high - to_low) / (high - low) * (x - low)


def cube(x: E, power: float = 3.0, signal_offset: int = -1) -> dict[str, E]:
    y = fn("pow", x, power)
    return {"CUBE": y, "CUBEs": y.lag(abs(signal_offset))}


def ifisher(x: E, amp: float = 1.0, bounds: tuple[float, float] | None = None) -> E:
    """The inverse Fisher transform of values from -1 to 1; those of other bounds are mapped there first."""
    x = x if bounds is None else remap(x, *bounds, -1.0, 1.0)
    z = fn("exp", amp * x)
    return (z - 1.0) / (z + 1.0)
