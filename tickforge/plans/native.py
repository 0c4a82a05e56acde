"""Graphs as Catalyst columns, and the plan of a study: native columns, one Python pass, native columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .expr import BOOLEAN_OPS, RECURSIVE_OPS, WINDOW_OPS, E, looks_ahead, recursive, topological
from .vector import Running, evaluate

#: Bytes of one series' inputs and results that the Python pass holds. Longer series go on in parts of this size.
PART_BYTES = 128 << 20
#: Windows from which a study is wide: its series all go through the Python pass, where arrays are rolled over in place,
#: because Spark builds each sliding frame anew for each row.
WIDE = 60
#: Weights up to which a weighted sum is written as lags; more are folded over the collected frame.
LAGS = 64


def _false(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def row_local(n: E, get) -> Column:
    """The column of a P node; get gives its arguments' columns."""
    op = n.op
    if op == "lit":
        return F.lit(n.p[0]).cast("double")
    a = [get(x) for x in n.args]
    if op in ("add", "sub", "mul"):
        return {"add": a[0] + a[1], "sub": a[0] - a[1], "mul": a[0] * a[1]}[op]
    if op == "div":
        return F.try_divide(a[0], a[1])
    if op in ("lt", "le", "gt", "ge", "eq"):
        return _false({"lt": a[0] < a[1], "le": a[0] <= a[1], "gt": a[0] > a[1], "ge": a[0] >= a[1], "eq": a[0] == a[1]}[op])
    if op in ("and", "or"):
        return a[0] & a[1] if op == "and" else a[0] | a[1]
    if op == "period":
        return {"D": F.floor(a[0] / 86400), "W": F.floor((F.floor(a[0] / 86400) + 3) / 7)}.get(n.p[0], None) if n.p[0] in "DW" else _months(a[0], n.p[0])
    return {
        "abs": lambda x: F.abs(x), "sqrt": lambda x: F.when(x >= 0, F.sqrt(x)), "ln": lambda x: F.when(x > 0, F.log(x)), "exp": lambda x: F.exp(x), "pow": lambda x, y: F.pow(x, y), "sign": lambda x: F.signum(x),
        "floor": lambda x: F.floor(x).cast("double"), "atan": lambda x: F.atan(x), "gmax": lambda *x: F.greatest(*x), "gmin": lambda *x: F.least(*x), "smax": lambda *x: F.when(_all(x), F.greatest(*x)),
        "smin": lambda *x: F.when(_all(x), F.least(*x)), "not": lambda x: ~x, "where": lambda c, x, y: F.when(c, x).otherwise(y), "coalesce": lambda x, y: F.coalesce(x, y), "isnull": lambda x: x.isNull(), "int": lambda x: x.cast("double"),
    }[op](*a)


def _months(seconds: Column, anchor: str) -> Column:
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int"))
    return F.year(day) if anchor[0] == "Y" else F.year(day) * 12 + F.month(day) - 1


def _all(columns) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & c.isNotNull()
    return out


def _window(n: E, a: list[Column], keys: list[str], order: list[str]) -> Column:
    w = Window.partitionBy(*keys).orderBy(*order)
    op = n.op
    if op == "rownum":
        return F.row_number().over(w).cast("double")
    if op == "lag":
        return F.lag(a[0], n.p[0]).over(w) if n.p[0] >= 0 else F.lead(a[0], -n.p[0]).over(w)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    if op == "ffill":
        return F.last(a[0], ignorenulls=True).over(so_far)
    if op == "cum":
        if len(a) > 1:
            so_far = Window.partitionBy(*keys, a[1]).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        if n.p[0] == "first":
            return F.first(a[0], ignorenulls=True).over(so_far)
        return {"sum": F.sum, "max": F.max, "min": F.min}[n.p[0]](a[0]).over(so_far)
    if op == "dot":
        k = len(n.p)
        if k <= LAGS:
            out = None
            for i, weight in enumerate(n.p):
                term = (F.lag(a[0], k - 1 - i).over(w) if i < k - 1 else a[0]) * F.lit(weight)
                out = term if out is None else out + term
            return out
        frame = w.rowsBetween(-(k - 1), 0)
        weights = F.array(*[F.lit(x) for x in n.p])
        total = F.aggregate(F.zip_with(F.collect_list(a[0]).over(frame), weights, lambda x, y: x * y), F.lit(0.0), lambda x, y: x + y)
        return F.when(F.count(a[0]).over(frame) == k, total)
    how, size, minp, more = n.p
    p = dict(more)
    frame = w.rowsBetween(-(size - 1), 0)
    x = a[0]
    count = F.count(x).over(frame)
    values = F.collect_list(x).over(frame)
    if how in ("sum", "mean", "min", "max"):
        out = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}[how](x).over(frame)
    elif how in ("var", "std"):
        f = {("var", 1): F.var_samp, ("var", 0): F.var_pop, ("std", 1): F.stddev_samp, ("std", 0): F.stddev_pop}[how, p.get("ddof", 1)]
        out = f(x).over(frame)
    elif how == "quantile":
        out = F.percentile(x, p["q"]).over(frame)
    elif how == "mad":
        out = F.aggregate(F.transform(values, lambda v: F.abs(v - F.avg(x).over(frame))), F.lit(0.0), lambda s, v: s + v) / size
    elif how in ("argmax", "argmin"):
        # The extreme with its row, the latest of equals.
        row = F.row_number().over(w)
        at = F.struct(x.alias("x"), (row if how == "argmax" else -row).alias("row"))
        best = (F.max if how == "argmax" else F.min)(F.when(x.isNotNull(), at)).over(frame)
        out = (row - F.abs(best["row"])).cast("double")
    elif how == "prank":
        out = 100.0 * F.size(F.filter(values, lambda v: v < x)) / (size - 1)
    else:
        flat = F.var_pop(x).over(frame) <= 1e-14 * F.greatest(F.lit(1.0), F.pow(F.avg(x).over(frame), 2))
        if how == "skew":
            out = F.when(~flat, F.lit(((size * (size - 1)) ** 0.5) / (size - 2)) * F.skewness(x).over(frame))
        else:
            out = F.when(~flat, F.lit((size - 1) / ((size - 2) * (size - 3))) * ((size + 1) * F.kurtosis(x).over(frame) + 6))
    return F.when(count >= max(1, minp), out)


def compile_native(df: DataFrame, nodes: list[E], have: dict[str, str], keys: list[str], order: list[str], number: dict[str, str]) -> tuple[DataFrame, dict[str, Column]]:
    """df with the windows that nodes need, and the columns of nodes. Windows nest by levels; all those of one level
    are one select over one partitioning and order, which Spark sorts once."""
    todo = topological(nodes, set(have))
    level: dict[str, int] = {}
    for n in todo:
        level[n.key] = 0 if n.key in have else max([level[a.key] for a in n.args], default=0) + (n.op in WINDOW_OPS)
    stored = dict(have)

    def get(n: E) -> Column:
        if n.key in have and n.op in BOOLEAN_OPS:
            return F.col(f"`{have[n.key]}`") == 1.0  # the Python pass gives doubles
        if n.key in stored:
            return F.col(f"`{stored[n.key]}`")
        if n.op == "col":
            return F.col(f"`{n.p[0]}`")
        return row_local(n, get)

    for depth in range(1, max(level.values(), default=0) + 1):
        here = [n for n in todo if n.op in WINDOW_OPS and level[n.key] == depth and n.key not in stored]
        inputs = {a.key: a for n in here for a in n.args if a.op not in ("col", "lit") and a.key not in stored}
        if inputs:
            new = {number.setdefault(k, f"_n{len(number)}"): get(a) for k, a in inputs.items()}
            df = df.withColumns(new)
            stored |= {k: number[k] for k in inputs}
        if here:
            new = {number.setdefault(n.key, f"_n{len(number)}"): _window(n, [get(a) for a in n.args], keys, order) for n in here}
            df = df.withColumns(new)
            stored |= {n.key: number[n.key] for n in here}
    return df, {n.key: get(n) for n in nodes}


def plan(df: DataFrame, outputs: dict[str, E], keys: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """keep columns and the outputs. Nodes with nothing recursive below are native; recursive ones, and what lies
    between them, run in one Python pass over series brought together once; the rest is native again. A study of WIDE or
    more windows runs in the pass as a whole."""
    number: dict[str, str] = {}
    nodes = list(outputs.values())
    everything = topological(nodes)
    deep = {n.key for n in everything if recursive(n)}
    wide = sum(n.op in WINDOW_OPS for n in everything) >= WIDE and not any(looks_ahead(n) for n in nodes)
    if wide:
        deep = {n.key for n in everything if n.op not in ("col", "lit")}
    if not deep:
        df, cols = compile_native(df, nodes, {}, keys, order, number)
        return df.select(*[F.col(f"`{c}`") for c in keep], *[cols[n.key].alias(name) for name, n in outputs.items()])
    feeds: set[str] = set(deep) if wide else set()
    for n in everything:
        if n.op in RECURSIVE_OPS:
            feeds |= {x.key for x in topological(list(n.args)) if x.key in deep}
            feeds.add(n.key)
    python = [n for n in everything if n.key in feeds]
    edge = {a.key: a for n in python for a in n.args if a.key not in deep and a.op != "lit"}
    after = [n for n in everything if n.key in deep and n.key not in feeds]
    if wide:
        edge |= {n.key: n for n in nodes if n.op in ("col", "lit")}
    wanted = {n.key: n for n in nodes if n.key in feeds} | {a.key: a for n in after for a in n.args if a.key in feeds}
    wanted = {k: n for k, n in wanted.items() if n.op != "scan"}
    # Native windows that outputs or later nodes need are made before the pass too and carried through it: after it, only
    # windows over its own results cost another exchange.
    needed = {n.key: n for n in nodes if n.key not in deep} | {a.key: a for n in after for a in n.args if a.key not in deep}
    carried = {k: n for k, n in needed.items() if k not in edge and any(x.op in WINDOW_OPS for x in topological([n]))}
    df, cols = compile_native(df, [*edge.values(), *carried.values()], {}, keys, order, number)
    passing = dict.fromkeys([*keys, *order, *keep, *[x.p[0] for n in nodes for x in topological([n]) if x.op == "col"]])
    names = {k: number.setdefault(k, f"_n{len(number)}") for k in edge}
    df = df.select(*[F.col(f"`{c}`") for c in passing], *[cols[k].cast("double").alias(names[k]) for k in edge], *[cols[k].cast("double").alias(number.setdefault(k, f"_n{len(number)}_")) for k in carried])
    through = {k: number[k] for k in (*carried, *[k for k in edge if k in needed])}
    results = {k: number.setdefault(k, f"_n{len(number)}") for k in wanted}
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in passing or f.name in through.values()], *[f"`{c}` double" for c in results.values()]])
    flags = {k for k, n in edge.items() if n.op in BOOLEAN_OPS}
    run = _series_pass(list(wanted.values()), list(results.values()), names, flags, keys, [*passing, *through.values()])
    df = df.repartition(*keys).sortWithinPartitions(*keys, *order) if keys else df.coalesce(1).sortWithinPartitions(*order)
    df = df.mapInPandas(run, schema)
    df, cols = compile_native(df, nodes, results | through, keys, order, number)
    return df.select(*[F.col(f"`{c}`") for c in keep], *[cols[n.key].alias(name) for name, n in outputs.items()])


def _series_pass(nodes: list[E], results: list[str], names: dict[str, str], flags: set[str], keys: list[str], passing: list[str]):
    """Series arrive one after the other in order. Each is evaluated at once while it is of PART_BYTES at most; a longer
    one goes on part by part with its state carried, so no series need fit in memory. A graph that looks ahead takes
    its series whole."""
    part_rows = max(1000, PART_BYTES // (8 * (len(passing) + len(names) + 2 * len(results))))
    ahead = any(looks_ahead(n) for n in nodes)

    def inputs(rows: pd.DataFrame) -> dict[str, np.ndarray]:
        return {k: rows[c].to_numpy(dtype=float) == 1.0 if k in flags else rows[c].to_numpy(dtype=float) for k, c in names.items()}

    def joined(rows: pd.DataFrame, values: list[np.ndarray]) -> pd.DataFrame:
        new = pd.DataFrame({c: v.astype(float) for c, v in zip(results, values, strict=True)}, index=rows.index)
        return pd.concat([rows[passing], new], axis=1)

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        return joined(rows, evaluate(nodes, {}, inputs(rows)))

    def going_on(running: Running, rows: pd.DataFrame) -> pd.DataFrame:
        given = inputs(rows)
        return joined(rows, running.step({names[k]: v for k, v in given.items()}))

    def given_columns() -> list[E]:
        """The same nodes over the pass's input columns."""
        made: dict[str, E] = {}

        def visit(n: E) -> E:
            if n.key not in made:
                made[n.key] = E("col", (), (names[n.key],)) if n.key in names else E(n.op, tuple(visit(a) for a in n.args), n.p)
            return made[n.key]

        return [visit(n) for n in nodes]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        key, count, running = None, 0, None
        for batch in batches:
            if not len(batch):
                continue
            if keys:
                changed = np.zeros(len(batch), dtype=bool)
                for k in keys:
                    v = batch[k]
                    changed[1:] |= (v.to_numpy()[1:] != v.to_numpy()[:-1]) & ~(v.isna().to_numpy()[1:] & v.isna().to_numpy()[:-1])
                starts = [0, *np.flatnonzero(changed).tolist(), len(batch)]
            else:
                starts = [0, len(batch)]
            for s, t in zip(starts, starts[1:], strict=False):
                part = batch.iloc[s:t]
                now = tuple(None if pd.isna(part[k].iloc[0]) else part[k].iloc[0] for k in keys)
                if now != key:
                    if held:
                        rows = pd.concat(held, ignore_index=True)
                        yield whole(rows) if running is None else going_on(running, rows)
                    held, key, count, running = [], now, 0, None
                held.append(part)
                count += len(part)
                if count >= part_rows and not ahead:
                    running = running or Running(given_columns())
                    yield going_on(running, pd.concat(held, ignore_index=True))
                    held, count = [], 0
        if held:
            rows = pd.concat(held, ignore_index=True)
            yield whole(rows) if running is None else going_on(running, rows)

    return run
