"""Series expressions: one definition of an operator, four ways to run it.

A node is row-local (P), a window over its series (W: lag, rolling frame, running aggregate) or recursive (S: an
exponential average or a scan kernel). `native` compiles P and W nodes to Catalyst columns, `vector` evaluates a graph
on arrays, `Stepper` runs it bar by bar with a state that can be saved, and `sql` writes it as DuckDB SQL for tests.
Missing values are null in Spark and SQL and NaN in Python."""

from __future__ import annotations

import math

WINDOW_OPS = {"lag", "roll", "dot", "cum", "ffill", "rownum"}
RECURSIVE_OPS = {"ewm", "scan", "pick"}
#: Nodes whose values are true or false.
BOOLEAN_OPS = {"lt", "le", "gt", "ge", "eq", "and", "or", "not", "isnull"}


class E:
    """A node. Equal nodes have equal keys, so shared parts of operators are computed once."""

    __slots__ = ("args", "key", "op", "p")

    def __init__(self, op: str, args: tuple[E, ...] = (), p: tuple = ()) -> None:
        self.op, self.args, self.p = op, args, p
        self.key = f"{op}{p!r}({','.join(a.key for a in args)})" if args or p else op

    def __add__(self, o): return E("add", (self, e(o)))  # noqa: E704
    def __radd__(self, o): return e(o) + self  # noqa: E704
    def __sub__(self, o): return E("sub", (self, e(o)))  # noqa: E704
    def __rsub__(self, o): return e(o) - self  # noqa: E704
    def __mul__(self, o): return E("mul", (self, e(o)))  # noqa: E704
    def __rmul__(self, o): return e(o) * self  # noqa: E704
    def __truediv__(self, o): return E("div", (self, e(o)))  # noqa: E704
    def __rtruediv__(self, o): return e(o) / self  # noqa: E704
    def __neg__(self): return e(0.0) - self  # noqa: E704
    def __lt__(self, o): return E("lt", (self, e(o)))  # noqa: E704
    def __le__(self, o): return E("le", (self, e(o)))  # noqa: E704
    def __gt__(self, o): return E("gt", (self, e(o)))  # noqa: E704
    def __ge__(self, o): return E("ge", (self, e(o)))  # noqa: E704
    def same(self, o): return E("eq", (self, e(o)))  # noqa: E704
    def __and__(self, o): return E("and", (self, o))  # noqa: E704
    def __or__(self, o): return E("or", (self, o))  # noqa: E704
    def __invert__(self): return E("not", (self,))  # noqa: E704
    def lag(self, k: int = 1): return self if k == 0 else E("lag", (self,), (int(k),))  # noqa: E704
    def diff(self, k: int = 1): return self - self.lag(k)  # noqa: E704
    def abs(self): return E("abs", (self,))  # noqa: E704
    def ffill(self): return E("ffill", (self,))  # noqa: E704


def e(x) -> E:
    return x if isinstance(x, E) else E("lit", (), (float(x),))


def col(name: str) -> E:
    return E("col", (), (name,))


def fn(op: str, *args) -> E:
    return E(op, tuple(e(a) for a in args))


def where(c: E, a, b) -> E:
    return E("where", (c, e(a), e(b)))


NULL = E("lit", (), (None,))
ROW = E("rownum")


def flag(c: E) -> E:
    return E("int", (c,))


def roll(how: str, x: E, n: int, minp: int | None = None, **p) -> E:
    return E("roll", (x,), (how, int(n), int(n if minp is None else minp), tuple(sorted(p.items()))))


def dot(x: E, weights) -> E:
    """Sum of weights * the last len(weights) values, oldest first; null until all are there."""
    return E("dot", (x,), tuple(float(w) for w in weights))


def cum(how: str, x: E, by: E | None = None) -> E:
    return E("cum", (x,) if by is None else (x, by), (how,))


def ewm(x: E, alpha: float, seed: int = 0) -> E:
    """y = alpha x + (1 - alpha) y, from the first value on, missing ones skipped. With seed = n the n-th row counts
    as the mean of the first n rows (missing if all are) and those before it as missing."""
    return E("ewm", (x,), (float(alpha), int(seed)))


def scan(kernel: str, inputs: list, outputs: int = 1, **params) -> list[E]:
    node = E("scan", tuple(e(i) for i in inputs), (kernel, tuple(sorted(params.items()))))
    return [E("pick", (node,), (i,)) for i in range(outputs)]


def topological(nodes: list[E], stop: set[str] = frozenset()) -> list[E]:
    out: dict[str, E] = {}

    def visit(n: E) -> None:
        if n.key in out:
            return
        if n.key not in stop:
            for a in n.args:
                visit(a)
        out[n.key] = n

    for n in nodes:
        visit(n)
    return list(out.values())


def looks_ahead(n: E) -> bool:
    return any(x.op == "lag" and x.p[0] < 0 for x in topological([n]))


def recursive(n: E) -> bool:
    return any(x.op in RECURSIVE_OPS for x in topological([n]))


# ---- scalar semantics, shared by the stepper and, vectorised, by arrays

NAN = math.nan


def _safe(f):
    def g(*a):
        try:
            r = f(*a)
        except (ValueError, ZeroDivisionError, OverflowError):
            return NAN
        return r if isinstance(r, bool) or not math.isinf(r) else NAN

    return g


def _skip(pick):
    def g(*a):
        left = [x for x in a if x == x]
        return pick(left) if left else NAN

    return g


def _strict(pick):
    return lambda *a: NAN if any(x != x for x in a) else pick(a)


SCALAR = {
    "add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": _safe(lambda a, b: a / b), "abs": abs, "sqrt": _safe(math.sqrt), "ln": _safe(math.log), "exp": _safe(math.exp),
    "pow": _safe(lambda a, b: a**b), "sign": lambda a: NAN if a != a else float((a > 0) - (a < 0)), "floor": lambda a: a if a != a else float(math.floor(a)), "atan": math.atan, "gmax": _skip(max), "gmin": _skip(min),
    "smax": _strict(max), "smin": _strict(min), "lt": lambda a, b: a < b, "le": lambda a, b: a <= b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b, "eq": lambda a, b: a == b, "and": lambda a, b: a and b,
    "or": lambda a, b: a or b, "not": lambda a: not a, "where": lambda c, a, b: a if c else b, "coalesce": lambda a, b: b if a != a else a, "isnull": lambda a: a != a, "int": float,
}


def _stats(how: str, v: list[float], p: dict) -> float:
    """A rolling figure of a full window without missing values."""
    n = len(v)
    if how == "sum":
        return math.fsum(v)
    if how == "mean":
        return math.fsum(v) / n
    if how in ("min", "max"):
        return min(v) if how == "min" else max(v)
    if how in ("var", "std"):
        ddof = p.get("ddof", 1)
        if n <= ddof:
            return NAN
        m = math.fsum(v) / n
        r = math.fsum((x - m) ** 2 for x in v) / (n - ddof)
        return math.sqrt(r) if how == "std" else r
    if how == "quantile":
        s, at = sorted(v), p["q"] * (n - 1)
        lo = math.floor(at)
        return s[lo] + (s[min(lo + 1, n - 1)] - s[lo]) * (at - lo)
    if how == "mad":
        m = math.fsum(v) / n
        return math.fsum(abs(x - m) for x in v) / n
    if how in ("argmax", "argmin"):
        best = max(v) if how == "argmax" else min(v)
        return float(next(i for i, x in enumerate(reversed(v)) if x == best))
    if how == "prank":
        return 100.0 * sum(x < v[-1] for x in v) / (n - 1)
    m = math.fsum(v) / n
    m2, m3, m4 = (math.fsum((x - m) ** k for x in v) / n for k in (2, 3, 4))
    if m2 <= 1e-14 * max(1.0, m * m):
        return NAN
    if how == "skew":
        return math.sqrt(n * (n - 1)) / (n - 2) * m3 / m2**1.5 if n > 2 else NAN
    return (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (m4 / m2**2 - 3) + 6) if n > 3 else NAN


class Stepper:
    """Runs a graph row by row. save() gives a JSON-able state and load() takes it up again; rows after load() give
    what they would have given in one run."""

    def __init__(self, nodes: list[E]) -> None:
        if any(looks_ahead(n) for n in nodes):
            raise ValueError("an operator that looks ahead cannot run on a stream")
        self.order = topological(nodes)
        at = {n.key: i for i, n in enumerate(self.order)}
        self.args = [[at[a.key] for a in n.args] for n in self.order]
        self.wanted = [at[n.key] for n in nodes]
        self.state = [self._new(n) for n in self.order]

    def _new(self, n: E):
        if n.op == "scan":
            from ..operators.kernels import KERNELS

            return KERNELS[n.p[0]](**dict(n.p[1]))
        return {"lag": lambda: [], "roll": lambda: [], "dot": lambda: [], "cum": lambda: [NAN, None], "ffill": lambda: [NAN], "rownum": lambda: [0], "ewm": lambda: [0, 0.0, 0, NAN]}.get(n.op, lambda: None)()

    def save(self) -> list:
        return [s.s if n.op == "scan" else s for n, s in zip(self.order, self.state, strict=True)]

    def load(self, saved: list) -> None:
        for i, n in enumerate(self.order):
            if n.op == "scan":
                self.state[i].s = saved[i]
            else:
                self.state[i] = saved[i]

    def step(self, row: dict[str, float]) -> list:
        values: list = []
        for i, n in enumerate(self.order):
            a = [values[k] for k in self.args[i]]
            values.append(self._one(n, a, self.state[i], row))
        return [values[i] for i in self.wanted]

    def _one(self, n: E, a: list, s, row: dict[str, float]):
        op = n.op
        if op == "col":
            v = row[n.p[0]]
            return NAN if v is None else v
        if op == "lit":
            return NAN if n.p[0] is None else n.p[0]
        if op in SCALAR:
            return SCALAR[op](*a)
        if op == "period":
            return period_of(a[0], n.p[0])
        if op == "rownum":
            s[0] += 1
            return float(s[0])
        if op == "lag":
            s.append(a[0])
            return s.pop(0) if len(s) > n.p[0] else NAN
        if op in ("roll", "dot"):
            size = n.p[1] if op == "roll" else len(n.p)
            s.append(a[0])
            if len(s) > size:
                s.pop(0)
            v = [x for x in s if x == x]
            if op == "dot":
                return math.fsum(w * x for w, x in zip(n.p, s, strict=True)) if len(v) == size else NAN
            return _stats(n.p[0], v, dict(n.p[3])) if len(v) >= max(1, n.p[2]) else NAN
        if op == "cum":
            how, x, by = n.p[0], a[0], a[1] if len(a) > 1 else None
            if by != s[1]:
                s[0], s[1] = NAN, by
            if x == x:
                s[0] = x if s[0] != s[0] else s[0] + x if how == "sum" else max(s[0], x) if how == "max" else min(s[0], x) if how == "min" else s[0]
            return s[0]
        if op == "ffill":
            if a[0] == a[0]:
                s[0] = a[0]
            return s[0]
        if op == "ewm":
            alpha, seed = n.p
            x = a[0]
            s[0] += 1
            if seed and s[0] <= seed:
                if x == x:
                    s[1], s[2] = s[1] + x, s[2] + 1
                if s[0] == seed and s[2]:
                    s[3] = s[1] / s[2]
                return s[3]
            if x == x:
                s[3] = x if s[3] != s[3] else alpha * x + (1 - alpha) * s[3]
            return s[3]
        if op == "scan":
            return s.run(*a)
        return a[0][n.p[0]]  # pick


def period_of(seconds: float, anchor: str) -> float:
    """The number of the day, week, month or year that a time (epoch seconds, UTC) is in."""
    import datetime

    day = math.floor(seconds / 86400)
    if anchor == "D":
        return float(day)
    if anchor == "W":
        return float((day + 3) // 7)
    d = datetime.date(1970, 1, 1) + datetime.timedelta(days=day)
    return float(d.year if anchor[0] == "Y" else d.year * 12 + d.month - 1)
