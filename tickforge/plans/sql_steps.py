"""Scan kernels as one step of a recursive SQL query: from the last row's state and this row's inputs to the next state
and the outputs. Written apart from the kernels, so that the two can be held against each other."""

from __future__ import annotations

import math
from collections.abc import Callable

#: kernel -> (initial state, step). step(state, inputs, row number from 1, parameters) gives (next state, outputs,
#: *stages), all as SQL; a missing value is null. A stage names values that later stages, the state and outputs may use.
STEPS: dict[str, tuple[dict[str, str], Callable]] = {}
_NULL, _ZERO, _LIST = "CAST(NULL AS DOUBLE)", "CAST(0 AS DOUBLE)", "CAST([] AS DOUBLE[])"


def step(**state: str):
    def add(f: Callable) -> Callable:
        STEPS[f.__name__] = (state, f)
        return f

    return add


def _case(*parts: str) -> str:
    """CASE of condition, value, ..., otherwise."""
    whens = " ".join(f"WHEN {c} THEN {v}" for c, v in zip(parts[:-1:2], parts[1::2], strict=True))
    return f"(CASE {whens} ELSE {parts[-1]} END)"


@step(y=_ZERO)
def ratchet_decay(s, a, i, p):
    y = f"greatest(0.0, {a[0]}, CASE WHEN {i} > 1 THEN {s['y']} * {1 - 1 / p['length']!r} END)"
    return {"y": y}, [y]


@step(y=_NULL)
def adaptive(s, a, i, p):
    x, share, first = a
    last = _case(f"{i} > {p['start'] + 1}", s["y"], repr(p["zero"]) if "zero" in p else _NULL)
    y = _case(f"{i} <= {p['start']}", _NULL, f"{i} = {p['start'] + 1} AND {first} IS NOT NULL", first, f"({share} * {x} + (1 - {share}) * {last})")
    return {"y": y}, [y]


@step(y=_NULL)
def mcginley(s, a, i, p):
    moved = f"({s['y']} + ({a[0]} - {s['y']}) / nullif({p['c'] * p['length']!r} * pow({a[0]} / nullif({s['y']}, 0), 4), 0))"
    return {"y": _case(f"{i} = 1", a[0], moved)}, [_case(f"{i} = 1", _NULL, moved)]


@step(y=_ZERO, before=_ZERO, x=_ZERO)
def smoother(s, a, i, p):
    y = _case(f"{i} <= 2", a[0] if p["passes"] else _ZERO, f"({0.5 * p['c']!r} * ({a[0]} + {s['x']}) + {p['b']!r} * {s['y']} - {p['a'] ** 2!r} * {s['before']})")
    return {"y": y, "before": s["y"], "x": a[0]}, [y]


@step(y1=_ZERO, y2=_ZERO, y3=_ZERO)
def three_pole(s, a, i, p):
    d = [repr(v) for v in p["d"]]
    y = _case(f"{i} <= 3", a[0], f"({d[0]} * {a[0]} + {d[1]} * {s['y1']} + {d[2]} * {s['y2']} + {d[3]} * {s['y3']})")
    return {"y1": y, "y2": s["y1"], "y3": s["y2"]}, [y]


@step(past=_LIST, power=_ZERO)
def flex(s, a, i, p):
    n, f, past = p["n"], a[0], s["past"]
    m = n - 1 if p["slope"] else n
    tilt = f"({past}[1] - {f}) / {n}" if p["slope"] else "0.0"
    gaps = f"(({m} * {f} - list_sum({past}[{n - m + 1}:{n}]) + {m * (m + 1) / 2!r} * ({tilt})) / {n})"
    full = f"len({past}) = {n}"
    power = _case(full, f"({p['alpha']!r} * {gaps} * {gaps} + {1 - p['alpha']!r} * {s['power']})", s["power"])
    longer = f"list_append({past}, {f})"
    return {"past": _case(full, f"{longer}[2:]", longer), "power": power}, [_case(full, _case(f"{power} = 0", "0.0", f"{gaps} / sqrt({power})"), _NULL)]


@step(x=_ZERO, hp=_ZERO, f1=_ZERO, f2=_ZERO)
def sinewave(s, a, i, p):
    n, bars = p["length"], p["bars"]
    whole, root = (360, 180) if p["initial"] else (2 * math.pi, math.pi)
    keep = (1 - math.sin(whole / n)) / math.cos(whole / n)
    c3 = -math.exp(-2 * math.sqrt(2) * math.pi / bars)
    c2 = 2 * math.exp(-math.sqrt(2) * math.pi / bars) * math.cos(math.sqrt(2) * root / bars)
    warm = f"{i} <= {n}"
    hp = f"({(1 + keep) / 2!r} * ({a[0]} - {s['x']}) + {keep!r} * {s['hp']})"
    f = f"({(1 - c2 - c3) / 2!r} * ({hp} + {s['hp']}) + {c2!r} * {s['f1']} + {c3!r} * {s['f2']})"
    power = f"(({f} * {f} + {s['f1']} * {s['f1']} + {s['f2']} * {s['f2']}) / 3)"
    wave = f"(({f} + {s['f1']} + {s['f2']}) / 3 / nullif(sqrt({power}), 0))"
    nxt = {"x": a[0], "hp": hp, "f1": f, "f2": s["f1"]}
    return {k: _case(warm, _ZERO, v) for k, v in nxt.items()}, [_case(f"{i} = {n}", "0.0", warm, _NULL, wave)]


@step(v=_ZERO, y=_ZERO)
def fisher_transform(s, a, i, p):
    warm = f"{i} <= {p['length']}"
    raw = f"(0.66 * {a[0]} + 0.67 * {s['v']})"
    v = _case(f"{raw} < -0.99", "-0.999", f"{raw} > 0.99", "0.999", raw)
    y = f"(0.5 * (ln((1 + {v}) / (1 - {v})) + {s['y']}))"
    return {"v": _case(warm, _ZERO, v), "y": _case(warm, _ZERO, y)}, [_case(f"{i} = {p['length']}", "0.0", warm, _NULL, y)]


@step(r=_NULL, l1=_ZERO, l2=_ZERO, s1=_ZERO, s2=_ZERO, trend="CAST(1 AS DOUBLE)")
def qqe_bands(s, a, i, p):
    r, low, high = a
    l1, l2, s1, s2, last = s["l1"], s["l2"], s["s1"], s["s2"], s["r"]
    either = lambda f, x, y: f"CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN {f}({x}, {y}) END"
    long = _case(f"{last} > {l1} AND {r} > {l1}", either("greatest", l1, low), low)
    short = _case(f"{last} < {s1} AND {r} < {s1}", either("least", s1, high), high)
    crossed = lambda line, before: f"({r} > {line} AND {last} < {before}) OR ({r} <= {line} AND {last} >= {before})"
    trend = _case(crossed(s1, s2), "1.0", crossed(l1, l2), "-1.0", s["trend"])
    one = f"{i} = 1"
    nxt = {"r": r, "l1": _case(one, _ZERO, long), "l2": _case(one, _ZERO, l1), "s1": _case(one, _ZERO, short), "s2": _case(one, _ZERO, s1), "trend": _case(one, "1.0", trend)}
    up = f"{trend} = 1"
    return nxt, [_case(one, r, up, long, short), _case(one, _NULL, up, long, _NULL), _case(one, _NULL, up, _NULL, short)]


@step(f=_NULL, v=_ZERO, a=_ZERO, x=_NULL, y=_NULL, var=_ZERO)
def holt_winters(s, a, i, p):
    x, na, nb, nc, nd = a[0], p["na"], p["nb"], p["nc"], p.get("nd", 0.1)
    f0 = _case(f"{i} = 1", x, s["f"])
    f = f"({1 - na!r} * ({f0} + {s['v']} + 0.5 * {s['a']}) + {na!r} * {x})"
    v = f"({1 - nb!r} * ({s['v']} + {s['a']}) + {nb!r} * ({f} - {f0}))"
    acc = f"({1 - nc!r} * {s['a']} + {nc!r} * ({v} - {s['v']}))"
    y = f"({f} + {v} + 0.5 * {acc})"
    var = _case(f"{i} = 1", _ZERO, f"({1 - nd!r} * {s['var']} + {nd!r} * ({s['x']} - {s['y']}) * ({s['x']} - {s['y']}))")
    return {"f": f, "v": v, "a": acc, "x": x, "y": y, "var": var}, [y, f"sqrt({s['var']})"]


@step(falling=_ZERO, sar=_NULL, ep=_NULL, af=_ZERO, h=_NULL, l=_NULL, c=_NULL)
def parabolic(s, a, i, p):
    high, low, close = a
    af0 = repr(float(p["af0"]))
    one, two = f"{i} = 1", f"{i} = 2"
    dn = f"({s['l']} - {low})"
    falling = f"({_case(two, _case(f'{dn} > ({high} - {s["h"]}) AND {dn} > 0', '1.0', '0.0'), s['falling'])} = 1)"
    ep = _case(two, _case(falling, s["l"], s["h"]), s["ep"])
    af = _case(two, af0, s["af"])
    start = _case(two, f"coalesce({s['c']}, {_case(falling, s['h'], s['l'])})", s["sar"])
    raw = f"({start} + {af} * ({ep} - {start}))"
    turned = f"(CASE WHEN {falling} THEN {high} > {raw} ELSE {low} < {raw} END)"
    extreme = f"(CASE WHEN {falling} THEN {low} < {ep} ELSE {high} > {ep} END)"
    ep1 = _case(extreme, _case(falling, low, high), ep)
    af1 = _case(extreme, f"least({af} + {af0}, {float(p['max_af'])!r})", af)
    sar = _case(turned, ep1, _case(falling, f"greatest({s['h']}, {raw})", f"least({s['l']}, {raw})"))
    down = _case(turned, _case(falling, "0.0", "1.0"), _case(falling, "1.0", "0.0"))
    af2, ep2 = _case(turned, af0, af1), _case(turned, _case(f"{down} = 1", low, high), ep1)
    nxt = {"falling": _case(one, _ZERO, down), "sar": _case(one, _NULL, sar), "ep": _case(one, _NULL, ep2), "af": _case(one, af0, af2), "h": high, "l": low, "c": close}
    outs = [_case(one, _NULL, f"{down} = 1", _NULL, sar), _case(one, _NULL, f"{down} = 1", sar, _NULL), _case(one, af0, af2), _case(f"{one} OR NOT {turned}", "0.0", "1.0")]
    return nxt, outs


@step(d="CAST(1 AS DOUBLE)", lb=_NULL, ub=_NULL)
def super_trend(s, a, i, p):
    close, low, high = a
    up, dn, one = f"{close} > {s['ub']}", f"{close} < {s['lb']}", f"{i} = 1"
    d = _case(one, "1.0", up, "1.0", dn, "-1.0", s["d"])
    lb = _case(f"{one} OR {up} OR {dn}", low, f"{s['d']} > 0 AND {low} < {s['lb']}", s["lb"], low)
    ub = _case(f"{one} OR {up} OR {dn}", high, f"{s['d']} < 0 AND {high} > {s['ub']}", s["ub"], high)
    rising = f"{d} > 0"
    outs = [_case(rising, lb, ub), _case(f"{i} <= {p['length']}", _NULL, d), _case(rising, lb, _NULL), _case(rising, _NULL, ub)]
    return {"d": d, "lb": lb, "ub": ub}, [_case(one, _NULL, x) for x in outs]


@step(y=_ZERO)
def alpha_trend(s, a, i, p):
    low, high, strong = a
    y = _case(f"{strong} <> 0", _case(f"{low} < {s['y']}", s["y"], low), _case(f"{high} > {s['y']}", s["y"], high))
    return {"y": _case(f"{i} = 1", _ZERO, y)}, [_case(f"{i} = 1", _NULL, y)]


@step(y=_NULL)
def trailing_stop(s, a, i, p):
    close, up, width = a
    y = _case(f"{up} <> 0", f"({close} - {width})", f"({close} + {width})")
    held = _case(f"({up} <> 0 AND {y} < {s['y']}) OR ({up} = 0 AND {y} > {s['y']})", s["y"], y)
    return {"y": _case(f"{i} <= {p['start']}", _NULL, held)}, [_case(f"{i} <= {p['start']}", _NULL, held)]


@step(y=_NULL)
def multiplied(s, a, i, p):
    y = _case(f"{i} = 1", a[1], f"({s['y']} * {a[0]})")
    return {"y": y}, [y]


def _past(values: str, k: int) -> str:
    """The k-th last element of a list, 0 before its first."""
    return f"coalesce({values}[len({values}) - {k}], 0.0)"


def _pushed(values: str, x: str, size: int) -> str:
    return f"list_append({values}, {x})[-{size}:]"


@step(up=_NULL, dn=_NULL, out="CAST([0.0] AS DOUBLE[])", means="CAST([0.0] AS DOUBLE[])")
def relative_volatility(s, a, i, p):
    x, one = a[0], f"{i} = 1"
    over, under = f"abs({x} - {s['up']})", f"abs({x} - {s['dn']})"
    beyond = _case(f"{over} = {under}", "0.0", f"greatest({over}, {under})")
    out = _pushed(s["out"], beyond, 10)
    means = _pushed(s["means"], f"(list_sum({out}) / 10)", 66)
    usual = f"list_avg({means})"
    relative = f"least(greatest(coalesce({beyond} / nullif({usual}, 0), 0), 1.0), {p['reach']!r})"
    speed = f"pow({relative}, {p['power']!r})"
    kept = f"pow({p['hold']!r}, sqrt({speed}))"
    up = _case(f"{x} > {s['up']}", x, f"({x} - {kept} * ({x} - {s['up']}))")
    dn = _case(f"{x} < {s['dn']}", x, f"({x} - {kept} * ({x} - {s['dn']}))")
    start = {"up": x, "dn": x, "out": "CAST([0.0] AS DOUBLE[])", "means": "CAST([0.0] AS DOUBLE[])"}
    now = {"up": up, "dn": dn, "out": out, "means": means}
    return {k: _case(one, start[k], now[k]) for k in now}, [_case(one, "1.0", speed)]


@step(y=_NULL, d=_ZERO)
def pursuit(s, a, i, p):
    target, alpha = a
    d = f"((1 - {alpha}) * (1 - {alpha}) * ({target} - {s['y']}) + {alpha} * {alpha} * {s['d']})"
    y = _case(f"{i} = 1", target, f"({s['y']} + {d})")
    return {"y": y, "d": _case(f"{i} = 1", _ZERO, d)}, [y]


@step(pf="CAST([0.0] AS DOUBLE[])", k=_ZERO, y=_ZERO)
def schaff(s, a, i, p):
    x, low, high = a
    one = f"{i} = 1"
    k = _case(f"{low} > 0", f"(100 * ({x} - {low}) / (CASE WHEN {high} = {low} THEN 2.220446049250313e-16 ELSE {high} - {low} END))", s["k"])
    last = f"{s['pf']}[len({s['pf']})]"
    tidy = lambda v: f"(floor(({v}) * 1e8 + 0.5) / 1e8)"
    new = tidy(f"{last} + {p['factor']!r} * ({k} - {last})")
    pf = _pushed(s["pf"], new, p["length"])
    spread = f"(list_max({pf}) - list_min({pf}))"
    d = f"(100 * ({new} - list_min({pf})) / (CASE WHEN {spread} = 0 THEN 1.0 ELSE {spread} END))"
    y = tidy(f"{s['y']} + {p['factor']!r} * ({d} - {s['y']})")
    first = "CAST([0.0] AS DOUBLE[])"
    return {"pf": _case(one, first, pf), "k": _case(one, _ZERO, k), "y": _case(one, _ZERO, y)}, [_case(one, "0.0", y), _case(one, "0.0", new)]


@step(v=_NULL, swing=_ZERO)
def swings(s, a, i, p):
    low, high, is_low, is_high = a
    dev = 0.01 * p["deviation"]

    def point(v: str, swing: str, value: str, there: str, way: str) -> tuple[str, str, str]:
        """(whether it is a point, its change)"""
        change = f"(({value} - {v}) / {v})"
        moved = f"({swing} = {way} AND {change} * {way} > 0) OR ({swing} <> {way} AND {change} * {way} > {dev!r})"
        return f"({there} <> 0 AND {value} IS NOT NULL AND ({v} IS NULL OR {moved}))", _case(f"{v} IS NULL", "0.0", f"100 * {change}")

    dip, fall = point(s["v"], s["swing"], low, is_low, "-1.0")
    v1, swing1 = _case(dip, low, s["v"]), _case(dip, "-1.0", s["swing"])
    peak, rise = point(v1, swing1, high, is_high, "1.0")
    outs = [_case(peak, "1.0", dip, "-1.0", _NULL), _case(peak, high, dip, low, _NULL), _case(peak, rise, dip, fall, _NULL)]
    return {"v": _case(peak, high, v1), "swing": _case(peak, "1.0", swing1)}, outs


def _numbers(n: int) -> str:
    return f"CAST([{', '.join(['0.0'] * n)}] AS DOUBLE[])"


@step(bars=_ZERO, moved=_ZERO, x=_ZERO, m=_numbers(6), a=_numbers(6), up=_ZERO, whole=_ZERO)
def noise_free_rsi(s, a, i, p):
    n = p["length"]
    f, need = 3 / (n + 2), max(n - 1.0, 5.0)
    x = f"(100.0 * {a[0]})"
    d = f"({x} - {s['x']})"
    fresh, warm = f"{s['bars']} = 0", f"{i} <= {n}"

    def chain(r: str, v: str) -> list[dict[str, str]]:
        """The registers after v, pair by pair, and what comes out of each."""
        out, stages = v, []
        for k in range(3):
            one, two = f"{r}{2 * k}", f"{r}{2 * k + 1}"
            stages.append({one: f"({1 - f!r} * {s[r]}[{2 * k + 1}] + {f!r} * ({out}))"})
            stages.append({two: f"({f!r} * {one} + {1 - f!r} * {s[r]}[{2 * k + 2}])"})
            out = f"1.5 * {one} - 0.5 * {two}"
        return [*stages, {f"{r}_out": out}]

    counted = f"(CASE WHEN {need!r} <= {s['bars']} THEN {need + 1!r} ELSE {s['bars']} + 1 END)"
    moved = f"({s['moved']} = 1 OR ({need!r} >= {counted} AND {d} <> 0))"
    bars = _case(fresh, "1.0", f"{counted} = {need!r} AND NOT {moved}", "0.0", counted)
    up, size = _case(fresh, s["up"], "m_out"), _case(fresh, s["whole"], "a_out")
    listed = lambda r: "[" + ", ".join(f"{r}{k}" for k in range(6)) + "]"
    now = {
        "bars": bars, "moved": _case(fresh, "0.0", moved, "1.0", "0.0"), "x": x, "m": _case(fresh, s["m"], listed("m")),
        "a": _case(fresh, s["a"], listed("a")), "up": up, "whole": size,
    }
    value = _case(f"{need!r} < {bars} AND {size} > 1e-10", f"least(100.0, greatest(0.0, ({up} / {size} + 1) * 50))", "50.0")
    outs = [_case(f"{i} < {n}", _NULL, f"{i} = {n}", "50.0", value)]
    return ({k: _case(warm, s[k], v) for k, v in now.items()}, outs, *chain("m", d), *chain("a", f"abs({d})"))


#: The Hilbert registers: the last seven values of four series, and the figures that go on from bar to bar.
_CYCLE = {"xs": _LIST, **dict.fromkeys(("w", "d", "n", "q"), _numbers(7)), **dict.fromkeys(("i2", "q2", "re", "im", "pd", "sm"), _ZERO)}


def _hilbert(s: dict, x: str, sign: int, degrees: bool) -> list[dict[str, str]]:
    """Stages that name the cycle's registers after x as the state does, with an n before."""
    taps = lambda r: f"(0.0962 * {r}[7] + 0.5769 * {r}[5] - 0.5769 * {r}[3] - 0.0962 * {r}[1])"
    turn = "atan(nim / nre)"
    angle = f"degrees({turn})" if degrees else turn
    stages = [
        {"nxs": _pushed(s["xs"], x, 60), "g": f"(0.075 * {s['pd']} + 0.54)"},
        {"nw": f"list_append({s['w']}[2:7], 0.4 * {_past('nxs', 0)} + 0.3 * {_past('nxs', 1)} + 0.2 * {_past('nxs', 2)} + 0.1 * {_past('nxs', 3)})"},
        {"nd": f"list_append({s['d']}[2:7], g * {taps('nw')})"},
        {"nq": f"list_append({s['q']}[2:7], g * {taps('nd')})", "nn": f"list_append({s['n']}[2:7], nd[4])"},
        {"ni2": f"(0.2 * (nn[7] - g * {taps('nq')}) + 0.8 * {s['i2']})", "nq2": f"(0.2 * (nq[7] + g * {taps('nn')}) + 0.8 * {s['q2']})"},
        {
            "nre": f"(0.2 * (ni2 * {s['i2']} + nq2 * {s['q2']}) + 0.8 * {s['re']})",
            "nim": f"(0.2 * (ni2 * {s['q2']} + {sign} * nq2 * {s['i2']}) + 0.8 * {s['im']})",
        },
        {"raw": f"(CASE WHEN nim <> 0 AND nre <> 0 THEN 360 / {angle} ELSE 0.0 END)"},
        {"npd": f"(0.2 * least(greatest(least(raw, 1.5 * {s['pd']}), 0.67 * {s['pd']}, 6.0), 50.0) + 0.8 * {s['pd']})"},
        {"nsm": f"(0.33 * npd + 0.67 * {s['sm']})"},
    ]
    return stages


def _from(s: dict, first: int, i: str) -> dict[str, str]:
    """The registers' next state: as they were up to row `first`, but for the values themselves."""
    return {q: f"n{q}" if q == "xs" else _case(f"{i} <= {first}", s[q], f"n{q}") for q in s}


@step(**_CYCLE, phase=_ZERO, mama=_ZERO, fama=_ZERO)
def mesa(s, a, i, p):
    x, fast, slow = a[0], p["fastlimit"], p["slowlimit"]
    stages = [
        *_hilbert(s, x, 1, False), {"nphase": "(CASE WHEN nn[7] <> 0 THEN atan(nq[7] / nn[7]) ELSE 0.0 END)"},
        {"share": f"greatest(least({fast!r} / greatest({s['phase']} - nphase, 1.0), {fast!r}), {slow!r})"},
        {"nmama": f"(share * {x} + (1 - share) * {s['mama']})"}, {"nfama": f"(0.5 * share * nmama + (1 - 0.5 * share) * {s['fama']})"},
    ]
    now = _from(s, 3, i)
    return (now, [_case(f"{i} <= {p['prenan']}", _NULL, now[q]) for q in ("mama", "fama")], *stages)


@step(**_CYCLE, tr=_numbers(4))
def trendline(s, a, i, p):
    stages = [
        *_hilbert(s, a[0], -1, True), {"bars": "CAST(floor(nsm + 0.5) AS BIGINT)"},
        {"ntr": f"list_append({s['tr']}[2:4], CASE WHEN bars > 0 THEN list_sum(nxs[-bars:]) / bars ELSE 0.0 END)"},
    ]
    now = _from(s, 6, i)
    tr = now["tr"]
    smooth = f"(0.4 * {tr}[4] + 0.3 * {tr}[3] + 0.2 * {tr}[2] + 0.1 * {tr}[1])"
    return (now, [_case(f"{i} <= {p['prenan']}", _NULL, f"{i} <= 13", a[0], smooth)], *stages)


_BINS = ("up", "down", "flat", "total", "number")


@step(low=_NULL, high=_NULL, **dict.fromkeys(_BINS, _LIST))
def online_profile(s, a, i, p):
    x, volume, side = a
    n = p["width"]
    known = f"({x} IS NOT NULL AND {volume} IS NOT NULL)"
    spot = lambda v: f"(CASE WHEN nhigh > nlow THEN least({n - 1}, CAST(floor(({v} - nlow) / (nhigh - nlow) * {n}) AS INTEGER)) ELSE {n // 2} END)"
    empty = f"len({s['up']}) = 0"
    old = f"({s['low']} + (j - 0.5) * ({s['high']} - {s['low']}) / {n})"
    same = f"(nlow = {s['low']} AND nhigh = {s['high']})"
    new = {
        "up": _case(f"{side} > 0", volume, "0.0"), "down": _case(f"{side} < 0", volume, "0.0"), "flat": _case(f"{side} = 0", volume, "0.0"),
        "total": x, "number": "1.0",
    }
    every = f"range(1, {n + 1})"

    def held(q: str) -> str:
        kept = f"CASE WHEN {empty} THEN 0.0 WHEN {same} THEN {s[q]}[k] ELSE list_sum(list_transform({every}, lambda j: CASE WHEN goes[j] = k - 1 THEN {s[q]}[j] ELSE 0.0 END)) END"
        return f"list_transform({every}, lambda k: {kept} + CASE WHEN k - 1 = here THEN {new[q]} ELSE 0.0 END)"

    after = {"low": _case(known, "nlow", s["low"]), "high": _case(known, "nhigh", s["high"])}
    after |= {q: _case(known, f"n{q}", s[q]) for q in _BINS}
    stages = [
        {"nlow": f"coalesce(least({s['low']}, {x}), {x})", "nhigh": f"coalesce(greatest({s['high']}, {x}), {x})"},
        {"here": spot(x), "goes": f"list_transform({every}, lambda j: {spot(old)})"},
        {f"n{q}": held(q) for q in _BINS},
        {f"a{q}": v for q, v in after.items()},
        {"sums": f"list_transform({every}, lambda k: aup[k] + adown[k] + aflat[k])"},
        {"k": "list_position(sums, list_max(sums))", "wide": f"(ahigh - alow) / {n}"},
    ]
    low = "(alow + (k - 1) * wide)"
    mean = f"(CASE WHEN anumber[k] > 0 THEN atotal[k] / anumber[k] ELSE {low} + wide / 2 END)"
    outs = [low, mean, f"({low} + wide)", "aup[k]", "adown[k]", "aflat[k]", "(aup[k] + adown[k])"]
    return ({q: f"a{q}" for q in after}, [_case("len(aup) = 0", _NULL, v) for v in outs], *stages)
