"""Averages, ranges and other blocks of the operators, as expressions."""

import math

from ..plans.expr import E, cum, dot, e, ewm, fn, roll, scan, where

EPS = 2.220446049250313e-16


def sma(x: E, n: int) -> E:
    return roll("mean", x, n)


def ema(x: E, n: int, presma: bool = True) -> E:
    return ewm(x, 2 / (n + 1), n if presma else 0)


def rma(x: E, n: int) -> E:
    return ewm(x, 1 / n)


def smma(x: E, n: int) -> E:
    return ewm(x, 1 / n, n)


def wma(x: E, n: int, asc: bool = True) -> E:
    total = n * (n + 1) / 2
    w = [(i + 1) / total for i in range(n)]
    return dot(x, w if asc else w[::-1])


def normed(weights: list[float]) -> list[float]:
    total = sum(weights)
    return [w / total for w in weights]


def fibonacci(n: int) -> list[int]:
    out = [1, 1]
    while len(out) < n:
        out.append(out[-1] + out[-2])
    return out[:n]


def pascal(n: int) -> list[int]:
    return [math.comb(n - 1, k) for k in range(n)]


def triangle(n: int) -> list[int]:
    return [min(i, n - 1 - i) + 1 for i in range(n)]


def combination(n: int, r: int, repetition: bool = False) -> int:
    return math.comb(n + r - 1, r) if repetition else math.comb(n, r)


def zero(x: float) -> float:
    return 0.0 if abs(x) < EPS else x


def swma(x: E, n: int) -> E:
    return dot(x, normed(triangle(n)))


def gap(x: E, y: E) -> E:
    """x - y, with the machine epsilon where they are equal."""
    d = x - y
    return where(d.same(0.0), EPS, d)


def hl2(high: E, low: E) -> E:
    return (high + low) * 0.5


def hlc3(high: E, low: E, close: E) -> E:
    return (high + low + close) / 3.0


def adjusted(x: E, n: int) -> E:
    """Exponential mean over the weights there are so far, (1 - 1/n)^k each, from the n-th value on."""
    first = fn("isnull", cum("first", x).lag())
    known = ~fn("isnull", x)
    count = cum("sum", where(known, 1, 0))
    part = lambda v: ewm(where(known, where(first, v / float(n), v), E("lit", (), (None,))), 1 / n)
    return where(count >= float(n), part(x) / part(e(1.0)), E("lit", (), (None,)))


def true_range(high: E, low: E, close: E, drift: int = 1, prenan: bool = False) -> E:
    pc = close.lag(drift)
    out = fn("gmax", high - low, (high - pc).abs(), (pc - low).abs())
    return where(fn("isnull", pc), E("lit", (), (None,)), out) if prenan else out


def atr(high: E, low: E, close: E, n: int, mode: str = "rma", prenan: bool = False) -> E:
    """Average true range: the ranges up to row n count as their mean."""
    tr = true_range(high, low, close, prenan=prenan)
    if n <= 1:
        return ma(mode, tr, 1) if n == 1 and mode == "sma" else tr
    row = E("rownum")
    seeded = where(row < float(n), E("lit", (), (None,)), where(row.same(float(n)), roll("mean", tr, n, 1), tr))
    return ma(mode, seeded, n)


def move(x: E, n: int, scalar: float = 1.0) -> E:
    return (x - x.lag(n)) / x.lag(n) * scalar


def seeded_changes(x: E, n: int, drift: int = 1) -> E:
    """Wilder's average over changes, which are missing for `drift` rows: seeded with the mean of the first n of them."""
    return ewm(x, 1 / n, n + drift)


def rsi_like(x: E, n: int, mode: str = "rma", drift: int = 1, scalar: float = 100.0, seed: str | None = None) -> E:
    d = x.diff(drift)
    up, down = where(d < 0.0, 0.0, d), where(d > 0.0, 0.0, d)
    p, q = (seeded_changes(up, n, drift), seeded_changes(down, n, drift)) if seed == "sma" else (ma(mode, up, n), ma(mode, down, n))
    return scalar * p / (p + q.abs())


def slope_weights(n: int) -> list[float]:
    mean = (n + 1) / 2
    sxx = n * (n * n - 1) / 12
    return [(i + 1 - mean) / sxx for i in range(n)]


def line(x: E, n: int, at: float) -> E:
    """The value at `at` (rows are 1 to n) of the least-squares line through the last n values."""
    mean = (n + 1) / 2
    return dot(x, [1 / n + (at - mean) * w for w in slope_weights(n)])


def correlation(x: E, n: int) -> E:
    """The correlation of the last n values with their order."""
    spread = math.sqrt(n * (n + 1) / 12)
    return dot(x, slope_weights(n)) * spread / roll("std", x, n)


def ema_chain(x: E, n: int, levels: int, seed: str | None = None) -> list[E]:
    """An EMA, the EMA of it and so on. Later ones begin with the first value of the one before, or with seed="sma"
    with the mean of its first n values."""
    out = []
    for level in range(levels):
        # A level's first value is on row level * (n - 1) + 1, and rows before it are missing in the mean.
        x = ewm(x, 2 / (n + 1), level * (n - 1) + n) if seed == "sma" else ema(x, n)
        out.append(x)
    return out


def dema(x: E, n: int, seed: str | None = None) -> E:
    a, b = ema_chain(x, n, 2, seed)
    return 2.0 * a - b


def tema(x: E, n: int, seed: str | None = None) -> E:
    a, b, c = ema_chain(x, n, 3, seed)
    return 3.0 * (a - b) + c


def t3(x: E, n: int, a: float = 0.7, seed: str | None = None) -> E:
    es = [x, *ema_chain(x, n, 6, seed)]
    c1, c2, c3 = -(a**3), 3 * a * a + 3 * a**3, -6 * a * a - 3 * a - 3 * a**3
    return c1 * es[6] + c2 * es[5] + c3 * es[4] + (a**3 + 3 * a * a + 3 * a + 1) * es[3]


def trima(x: E, n: int) -> E:
    h = round(0.5 * (n + 1))
    return sma(sma(x, h), h)


def hma(x: E, n: int, mode: str = "wma") -> E:
    return ma(mode, 2.0 * ma(mode, x, n // 2) - ma(mode, x, n), int(math.sqrt(n)))


def sinwma(x: E, n: int) -> E:
    return dot(x, normed([math.sin((i + 1) * math.pi / (n + 1)) for i in range(n)]))


def zlma(x: E, n: int, mode: str = "ema") -> E:
    return ma(mode, 2.0 * x - x.lag((n - 1) // 2), n)


def linreg(x: E, n: int) -> E:
    return line(x, n, n)


def midpoint(x: E, n: int) -> E:
    return 0.5 * (roll("min", x, n) + roll("max", x, n))


def ssf(x: E, n: int, everget: bool = False, pi: float = 3.14159, sqrt2: float = 1.414) -> E:
    ratio = sqrt2 / n
    a = math.exp(-pi * ratio)
    b = 2 * a * math.cos(pi * ratio if everget else 180 * ratio)
    return scan("smoother", [x], a=a, b=b, c=a * a - b + 1, passes=True)[0]


def vidya(x: E, n: int, drift: int = 1) -> E:
    d = x.diff(drift)
    up, down = roll("sum", where(d < 0.0, 0.0, d), n), roll("sum", where(d > 0.0, 0.0, d), n).abs()
    share = ((up - down) / (up + down)).abs() * (2 / (n + 1))
    y = scan("adaptive", [x, share, E("lit", (), (None,))], start=n, zero=0.0)[0]
    return where(y.same(0.0), E("lit", (), (None,)), y)


def jurik(x: E, n: int, phase: float = 0.0) -> E:
    """Jurik's moving average. Relative volatility sets the smoothing's strength; an average of that strength follows
    the values, a second one what the first leaves, to an extent that `phase` gives; and the result goes after both."""
    half = (n - 1) / 2
    reach = max(math.log2(math.sqrt(half)) + 2, 0.0) if half else 0.0
    weight = reach * math.sqrt(half)
    steady = 0.45 * (n - 1) / (0.45 * (n - 1) + 2)
    power = max(reach - 2, 0.5)
    speed = scan("relative_volatility", [x], reach=max(1.0, reach ** (1 / power)), power=power, hold=weight / (weight + 1))[0]
    alpha = fn("pow", steady, speed)
    first = scan("adaptive", [x, 1.0 - alpha, x], start=0)[0]
    rest = ewm(x - first, 1 - steady)
    ahead = min(max(1.5 + phase / 100, 0.5), 2.5)
    return where(E("rownum") < float(n), E("lit", (), (None,)), scan("pursuit", [first + ahead * rest, alpha])[0])


MODES = {
    "dema": dema, "ema": ema, "fwma": lambda x, n: dot(x, normed(fibonacci(n))), "hma": hma, "linreg": linreg, "midpoint": midpoint, "pwma": lambda x, n: dot(x, normed(pascal(n))), "rma": rma, "sinwma": sinwma, "sma": sma,
    "ssf": ssf, "swma": swma, "t3": t3, "tema": tema, "trima": trima, "vidya": vidya, "wma": wma,
}


def ma(mode: str | None = None, x: E | None = None, n: int = 10):
    """The moving average of a name (ema for unknown ones); without arguments the list of names."""
    if mode is None:
        return sorted(MODES)
    return MODES.get(mode, ema)(x, n)


def unsigned_differences(x: E, lag: int = 1) -> tuple[E, E]:
    """1 where x rose, and 1 where it fell, over `lag` rows; 0 elsewhere."""
    d = fn("coalesce", x.diff(lag), 0.0)
    return where(d > 0.0, 1.0, 0.0), where(d < 0.0, 1.0, 0.0)


def horner(coefficients: list[float], v: float) -> float:
    """The polynomial of these coefficients, highest power first, at v."""
    y = 0.0
    for c in coefficients:
        y = y * v + c
    return y


def erf(x: float) -> float:
    return math.erf(x)


def strided_window(values: list, n: int) -> list[list]:
    """All runs of n consecutive values."""
    return [values[i : i + n] for i in range(len(values) - n + 1)]


def signed(x: E, first: float, k: int = 1) -> E:
    """The sign of the change, `first` where there is none before."""
    return fn("coalesce", fn("sign", x.diff(k)), e(first))
