"""Graphs on arrays: what the Python pass runs for a whole series at once."""

from collections import Counter

import numpy as np
import pandas as pd

from ..operators.kernels import KERNELS  # goes by value to workers, with what plug-ins add
from .expr import NAN, E, looks_ahead, period_of, topological

#: Windows that are copied at a time.
CHUNK = 1 << 14

_CMP = {"lt": np.less, "le": np.less_equal, "gt": np.greater, "ge": np.greater_equal, "eq": np.equal}


def _finite(x: np.ndarray) -> np.ndarray:
    return np.where(np.isinf(x), NAN, x)


def _roll(x: np.ndarray, how: str, n: int, minp: int, p: dict) -> np.ndarray:
    r = pd.Series(x).rolling(n, min_periods=max(1, minp))
    if how in ("sum", "mean", "min", "max"):
        return getattr(r, how)().to_numpy()
    if how in ("var", "std"):
        return getattr(r, how)(ddof=p.get("ddof", 1)).to_numpy()
    if how == "quantile":
        return r.quantile(p["q"]).to_numpy()
    if how in ("skew", "kurt"):
        flat = r.var(ddof=0).to_numpy() <= 1e-14 * np.maximum(1.0, r.mean().to_numpy() ** 2)
        return np.where(flat, NAN, getattr(r, how)().to_numpy())
    out = np.full(len(x), NAN)
    if len(x) >= n:
        windows = np.lib.stride_tricks.sliding_window_view(x, n)
        for at in range(0, len(windows), CHUNK):  # in parts, for what a window's copy takes
            w = windows[at : at + CHUNK]
            if how == "mad":
                v = np.abs(w - w.mean(axis=1, keepdims=True)).mean(axis=1)
            elif how == "prank":
                v = 100.0 * (w < w[:, -1:]).sum(axis=1) / (n - 1)
            else:
                v = (np.argmax if how == "argmax" else np.argmin)(w[:, ::-1], axis=1).astype(float)
            out[at + n - 1 : at + n - 1 + len(w)] = np.where(np.isnan(w).any(axis=1), NAN, v)
    return out


def _ewm(x: np.ndarray, alpha: float, seed: int) -> np.ndarray:
    if seed:
        x, first = x.copy(), x[:seed]
        if len(x) >= seed:
            x[seed - 1] = NAN if np.isnan(first).all() else np.nanmean(first)
        x[: seed - 1] = NAN
    return pd.Series(x).ewm(alpha=alpha, adjust=False, ignore_na=True).mean().to_numpy()


def evaluate(nodes: list[E], columns: dict[str, np.ndarray], given: dict[str, np.ndarray]) -> list[np.ndarray]:
    """columns: the series' columns by name, as floats; given: nodes that are known already, by key. An array is let go
    with its last use."""
    done = dict(given)
    size = len(next(iter((*columns.values(), *given.values()))))
    order = [n for n in topological(nodes, set(given)) if n.key not in done]
    uses = Counter(a.key for n in order for a in n.args)
    uses.update(n.key for n in nodes)
    with np.errstate(all="ignore"):
        for n in order:
            done[n.key] = _one(n, [done[a.key] for a in n.args], columns, size)
            for a in n.args:
                uses[a.key] -= 1
                if not uses[a.key]:
                    del done[a.key]
    return [done[n.key] for n in nodes]


class Running:
    """A graph over a series that comes in parts: arrays go in and out, and what a node needs of earlier parts (the
    last values of a window, a running figure, a kernel) is its state. save() gives it as JSON can hold it, load() takes
    it up again. The parts' results are those of the whole, however it is cut."""

    def __init__(self, nodes: list[E]) -> None:
        if any(looks_ahead(n) for n in nodes):
            raise ValueError("an operator that looks ahead cannot run on a stream")
        self.nodes, self.order = nodes, topological(nodes)
        self.state: list = [self._new(n) for n in self.order]

    @staticmethod
    def _new(n: E):
        if n.op == "scan":
            return KERNELS[n.p[0]](**dict(n.p[1]))
        # ewm: rows so far, sum and number of the values that seed it, last result; cum: last result and period.
        return {"lag": [], "roll": [], "dot": [], "cum": [NAN, NAN], "ffill": [NAN], "rownum": [0], "ewm": [0, 0.0, 0, NAN]}.get(n.op)

    def save(self) -> list:
        return [s.s if n.op == "scan" else s for n, s in zip(self.order, self.state, strict=True)]

    def load(self, saved: list) -> None:
        for i, n in enumerate(self.order):
            if n.op == "scan":
                self.state[i].s = saved[i]
            else:
                self.state[i] = saved[i]

    def step(self, columns: dict[str, np.ndarray]) -> list[np.ndarray]:
        size = len(next(iter(columns.values())))
        done: dict[str, np.ndarray] = {}
        with np.errstate(all="ignore"):
            for i, n in enumerate(self.order):
                a = [done[x.key] for x in n.args]
                done[n.key] = self._carried(i, n, a, size) if size and self.state[i] is not None else _one(n, a, columns, size)
        return [done[n.key] for n in self.nodes]

    def _carried(self, i: int, n: E, a: list, size: int):
        s = self.state[i]
        if n.op == "scan":
            return _scanned(s.run, a, size)
        if n.op == "rownum":
            s[0] += size
            return np.arange(s[0] - size + 1.0, s[0] + 1)
        x = a[0].astype(float)
        if n.op in ("lag", "roll", "dot"):
            back = {"lag": lambda: n.p[0], "roll": lambda: n.p[1] - 1, "dot": lambda: len(n.p) - 1}[n.op]()
            x = np.concatenate([s, x])
            self.state[i] = x[max(0, len(x) - back) :].tolist()
            return _one(n, [x], {}, len(x))[len(x) - size :]
        if n.op == "ffill":
            out = _one(n, [np.concatenate([s, x])], {}, size + 1)[1:]
            self.state[i] = [float(out[-1])]
            return out
        if n.op == "cum":
            by = [] if len(a) == 1 else [np.concatenate([[s[1] if s[1] == s[1] else a[1][0]], a[1]])]
            out = _one(n, [np.concatenate([s[:1], x]), *by], {}, size + 1)[1:]
            self.state[i] = [float(out[-1]), float(a[1][-1]) if by else NAN]
            return out
        alpha, seed = n.p
        rows, total, known, last = s
        if rows < seed:
            head = x[: seed - rows]
            total, known = total + float(np.nansum(head)), known + int((~np.isnan(head)).sum())
            x = x.copy()
            x[: len(head)] = NAN
            if rows + len(head) == seed:
                x[len(head) - 1] = total / known if known else NAN
        out = _ewm(np.concatenate([[last], x]), alpha, 0)[1:]
        self.state[i] = [rows + size, total, known, float(out[-1])]
        return out


def _scanned(step, a: list, size: int) -> np.ndarray:
    rows = [step(*r) for r in zip(*(x.tolist() for x in a), strict=True)]
    wide = max(map(len, rows), default=1)
    return np.array([r if len(r) == wide else (NAN,) * wide for r in rows], dtype=float).reshape(size, -1)


def _one(n: E, a: list, columns: dict[str, np.ndarray], size: int):
    op = n.op
    if op == "col":
        return columns[n.p[0]]
    if op == "lit":
        return np.full(size, NAN if n.p[0] is None else n.p[0])
    if op in _CMP:
        return _CMP[op](a[0], a[1])
    if op in ("add", "sub", "mul"):
        return {"add": np.add, "sub": np.subtract, "mul": np.multiply}[op](a[0], a[1])
    if op == "div":
        return _finite(a[0] / a[1])
    if op in ("abs", "sqrt", "exp", "sign", "floor"):
        return _finite(getattr(np, op)(a[0]))
    if op == "ln":
        return _finite(np.log(a[0]))
    if op == "atan":
        return np.arctan(a[0])
    if op == "pow":
        return _finite(np.power(a[0], a[1]))
    if op in ("gmax", "gmin", "smax", "smin"):
        f = {"gmax": np.fmax, "gmin": np.fmin, "smax": np.maximum, "smin": np.minimum}[op]
        out = a[0]
        for x in a[1:]:
            out = f(out, x)
        return out
    if op in ("and", "or"):
        return (np.logical_and if op == "and" else np.logical_or)(a[0], a[1])
    if op == "not":
        return ~a[0]
    if op == "where":
        return np.where(a[0], a[1], a[2])
    if op == "coalesce":
        return np.where(np.isnan(a[0]), a[1], a[0])
    if op == "isnull":
        return np.isnan(a[0])
    if op == "int":
        return a[0].astype(float)
    if op == "period":
        days, inverse = np.unique(np.floor(a[0] / 86400), return_inverse=True)
        return np.array([period_of(d * 86400, n.p[0]) for d in days.tolist()])[inverse]
    if op == "rownum":
        return np.arange(1.0, size + 1)
    if op == "lag":
        return pd.Series(a[0]).shift(n.p[0]).to_numpy()
    if op == "roll":
        return _roll(a[0], n.p[0], n.p[1], n.p[2], dict(n.p[3]))
    if op == "dot":
        k, out = len(n.p), np.full(size, NAN)
        if size >= k:
            out[k - 1 :] = np.lib.stride_tricks.sliding_window_view(a[0], k) @ np.array(n.p)
        return out
    if op == "cum":
        s = pd.Series(a[0])
        g = s.groupby((pd.Series(a[1]).diff() != 0).cumsum()) if len(a) > 1 else s
        how = n.p[0]
        if how == "first":
            return (g.transform("first") if len(a) > 1 else pd.Series(np.full(size, s.dropna().iloc[0] if s.notna().any() else NAN)).where(s.notna().cummax())).to_numpy()
        out = getattr(g, f"cum{how}")()
        return (out.groupby((pd.Series(a[1]).diff() != 0).cumsum()).ffill() if len(a) > 1 else out.ffill()).to_numpy()
    if op == "ffill":
        return pd.Series(a[0]).ffill().to_numpy()
    if op == "ewm":
        return _ewm(a[0], *n.p)
    if op == "scan":
        return _scanned(KERNELS[n.p[0]](**dict(n.p[1])).run, a, size)
    if a[0].shape[1] <= n.p[0]:
        return np.full(size, NAN)
    return a[0][:, n.p[0]]  # pick
