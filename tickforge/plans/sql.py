"""Graphs as DuckDB SQL: the reference that tests and the driver hold the Spark plans against."""

from __future__ import annotations

from .expr import RECURSIVE_OPS, WINDOW_OPS, E, topological
from .sql_steps import STEPS


class NotInSQL(ValueError):
    """The graph holds a scan kernel without a step in SQL."""


def _p(n: E, a: list[str]) -> str:
    op = n.op
    if op == "lit":
        return "CAST(NULL AS DOUBLE)" if n.p[0] is None else f"CAST({n.p[0]!r} AS DOUBLE)"
    if op in ("add", "sub", "mul"):
        return f"({a[0]} {dict(add='+', sub='-', mul='*')[op]} {a[1]})"
    if op == "div":
        return f"({a[0]} / nullif({a[1]}, 0))"
    if op in ("lt", "le", "gt", "ge", "eq"):
        return f"coalesce({a[0]} {dict(lt='<', le='<=', gt='>', ge='>=', eq='=')[op]} {a[1]}, false)"
    if op in ("gmax", "gmin"):
        return f"{'greatest' if op == 'gmax' else 'least'}({', '.join(a)})"
    if op in ("smax", "smin"):
        return f"CASE WHEN {' AND '.join(f'{x} IS NOT NULL' for x in a)} THEN {'greatest' if op == 'smax' else 'least'}({', '.join(a)}) END"
    if op == "period":
        day = f"floor({a[0]} / 86400)"
        date = f"(DATE '1970-01-01' + CAST({day} AS INTEGER))"
        return {"D": day, "W": f"floor(({day} + 3) / 7)", "Y": f"year({date})"}.get(n.p[0][0], f"(year({date}) * 12 + month({date}) - 1)")
    return {
        "abs": "abs({0})", "sqrt": "CASE WHEN {0} >= 0 THEN sqrt({0}) END", "ln": "CASE WHEN {0} > 0 THEN ln({0}) END", "exp": "exp({0})", "pow": "pow({0}, {1})", "sign": "CAST(sign({0}) AS DOUBLE)", "floor": "floor({0})",
        "atan": "atan({0})", "and": "({0} AND {1})", "or": "({0} OR {1})", "not": "(NOT {0})", "where": "CASE WHEN {0} THEN {1} ELSE {2} END", "coalesce": "coalesce({0}, {1})", "isnull": "({0} IS NULL)", "int": "CAST({0} AS DOUBLE)",
    }[op].format(*a)


def _w(n: E, a: list[str], keys: str, order: str) -> str:
    w = f"PARTITION BY {keys} ORDER BY {order}"
    op = n.op
    if op == "rownum":
        return f"CAST(row_number() OVER ({w}) AS DOUBLE)"
    if op == "lag":
        return f"{'lag' if n.p[0] >= 0 else 'lead'}({a[0]}, {abs(n.p[0])}) OVER ({w})"
    so_far = f"{w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    if op == "ffill":
        return f"last_value({a[0]} IGNORE NULLS) OVER ({so_far})"
    if op == "cum":
        if len(a) > 1:
            so_far = so_far.replace(f"PARTITION BY {keys}", f"PARTITION BY {keys}, {a[1]}")
        return f"first_value({a[0]} IGNORE NULLS) OVER ({so_far})" if n.p[0] == "first" else f"{n.p[0]}({a[0]}) OVER ({so_far})"
    if op == "dot":
        k = len(n.p)
        return "(" + " + ".join(f"{f'lag({a[0]}, {k - 1 - i}) OVER ({w})' if i < k - 1 else a[0]} * {x!r}" for i, x in enumerate(n.p)) + ")"
    how, size, minp, more = n.p
    p = dict(more)
    over = f"OVER ({w} ROWS BETWEEN {size - 1} PRECEDING AND CURRENT ROW)"
    x = a[0]
    listed = f"list({x}) {over}"
    pop = "pop" if p.get("ddof", 1) == 0 else "samp"
    flat = f"coalesce(var_pop({x}) {over}, 0) <= 1e-14 * greatest(1.0, pow(avg({x}) {over}, 2))"
    body = {
        "sum": f"sum({x}) {over}", "mean": f"avg({x}) {over}", "min": f"min({x}) {over}", "max": f"max({x}) {over}", "var": f"var_{pop}({x}) {over}", "std": f"stddev_{pop}({x}) {over}", "quantile": f"quantile_cont({x}, {p.get('q', 0.5)}) {over}",
        "mad": f"list_avg(list_transform({listed}, lambda v: abs(v - list_avg({listed}))))", "argmax": f"CAST(list_position(list_reverse({listed}), max({x}) {over}) - 1 AS DOUBLE)", "argmin": f"CAST(list_position(list_reverse({listed}), min({x}) {over}) - 1 AS DOUBLE)",
        "prank": f"100.0 * len(list_filter({listed}, lambda v: v < {x})) / {size - 1}", "skew": f"CASE WHEN NOT ({flat}) THEN skewness({x}) {over} END", "kurt": f"CASE WHEN NOT ({flat}) THEN kurtosis({x}) {over} END",
    }[how]
    return f"CASE WHEN count({x}) {over} >= {max(1, minp)} THEN {body} END"


def rounded(x: str, digits: int) -> str:
    """Rounded so that figures of two engines agree: large values to fewer places, and by a shift off exact ties; the
    largest to nine significant digits."""
    far = [(1e4, digits, 3.3e-8), (1e8, digits - 4, 3e-4), (1e15, digits - 8, 3.0)]
    cases = " ".join(f"WHEN abs({x}) < {top!r} THEN round({x} + {shift!r}, {d})" for top, d, shift in far)
    return f"CASE {cases} WHEN abs({x}) < 1e300 THEN TRY_CAST(printf('%.8e', {x}) AS DOUBLE) END + 0.0"


def sql(base: str, outputs: dict[str, E], keys: list[str], order: list[str], digits: int = 6) -> str:
    """A query over `base` (SQL with the series' columns) for keys, order and the rounded outputs."""
    nodes = topological(list(outputs.values()))
    if any(n.op == "scan" and n.p[0] not in STEPS for n in nodes):
        raise NotInSQL
    deep = WINDOW_OPS | (RECURSIVE_OPS - {"pick"})
    level: dict[str, int] = {}
    for n in nodes:
        level[n.key] = max([level[a.key] for a in n.args], default=0) + (n.op in deep)
    k, o = ", ".join(f'"{c}"' for c in keys), ", ".join(f'"{c}"' for c in order)
    ctes = [f"t0 AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY {o}) AS _rn FROM ({base}))"]
    stored: dict[str, str] = {}
    last = "t0"

    def get(n: E) -> str:
        if n.key in stored:
            return stored[n.key]
        if n.op == "pick":
            return f"{stored[n.args[0].key]}_o{n.p[0]}"
        return f'"{n.p[0]}"' if n.op == "col" else _p(n, [get(a) for a in n.args])

    def add(items: list[str], tag: str) -> None:
        nonlocal last
        ctes.append(f"{tag} AS (SELECT *, {', '.join(items)} FROM {last})")
        last = tag

    for depth in range(1, max(level.values(), default=0) + 1):
        here = [n for n in nodes if n.op in deep and level[n.key] == depth]
        inputs = {a.key: a for n in here for a in n.args if a.op not in ("col", "lit") and a.key not in stored}
        if inputs:
            named = [(q, f"c{len(stored) + i}", get(n)) for i, (q, n) in enumerate(inputs.items())]
            add([f"{x} AS {c}" for _, c, x in named], f"p{depth}")
            stored |= {q: c for q, c, _ in named}
        windows = [n for n in here if n.op in WINDOW_OPS]
        if windows:
            named = [(n.key, f"c{len(stored) + i}", _w(n, [get(a) for a in n.args], k, o)) for i, n in enumerate(windows)]
            add([f"{x} AS {c}" for _, c, x in named], f"w{depth}")
            stored |= {q: c for q, c, _ in named}
        means = [n for n in here if n.op == "ewm"]
        if means:
            names = [f"c{len(stored) + i}" for i in range(len(means))]
            items = []
            for n, c in zip(means, names, strict=True):
                x, seed = get(n.args[0]), n.p[1]
                items.append(f"CASE WHEN _rn < {seed} THEN NULL WHEN _rn = {seed} THEN avg(CASE WHEN _rn <= {seed} THEN {x} END) OVER (PARTITION BY {k}) ELSE {x} END AS x{c}" if seed else f"{x} AS x{c}")
            ctes.append(f"x{depth} AS MATERIALIZED (SELECT {k}, _rn, {', '.join(items)} FROM {last})")
            steps = [f"CASE WHEN r.{c} IS NULL THEN s.x{c} WHEN s.x{c} IS NULL THEN r.{c} ELSE {n.p[0]!r} * s.x{c} + (1 - {n.p[0]!r}) * r.{c} END" for n, c in zip(means, names, strict=True)]
            both = " AND ".join(f's."{c}" IS NOT DISTINCT FROM r."{c}"' for c in keys)
            ctes.append(
                f"e{depth} AS (SELECT {k}, _rn, {', '.join(f'CAST(x{c} AS DOUBLE) AS {c}' for c in names)} FROM x{depth} WHERE _rn = 1 UNION ALL "
                f"SELECT {', '.join(f's."{c}"' for c in keys)}, s._rn, {', '.join(steps)} FROM e{depth} r JOIN x{depth} s ON s._rn = r._rn + 1 AND {both})"
            )
            ctes.append(f"j{depth} AS (SELECT t.*, {', '.join(f'r.{c}' for c in names)} FROM {last} t JOIN e{depth} r ON t._rn = r._rn AND {' AND '.join(f't."{c}" IS NOT DISTINCT FROM r."{c}"' for c in keys)})")
            last = f"j{depth}"
            stored |= {n.key: c for n, c in zip(means, names, strict=True)}
        for n in (n for n in here if n.op == "scan"):
            c, (state, f), p = f"c{len(stored)}", STEPS[n.p[0]], dict(n.p[1])
            inputs = [f"i{c}_{j}" for j in range(len(n.args))]
            ctes.append(f"x{c} AS MATERIALIZED (SELECT {k}, _rn, {', '.join(f'CAST({get(a)} AS DOUBLE) AS {x}' for a, x in zip(n.args, inputs, strict=True))} FROM {last})")

            names = {q: f"{c}_{q}" for q in state}
            after, outs, *stages = f(names, inputs, "_rn", p)
            typed = {q: v if state[q].endswith("[])") else f"CAST({v} AS DOUBLE)" for q, v in after.items()}
            made = [f"{v} AS {names[q]}" for q, v in typed.items()] + [f"CAST({v} AS DOUBLE) AS {c}_o{j}" for j, v in enumerate(outs)]

            def stepped(rows: str) -> str:
                """One step over rows of keys, number, last state and inputs; a stage's names are columns of the next."""
                for stage in stages:
                    rows = f"SELECT *, {', '.join(f'{v} AS {n}' for n, v in stage.items())} FROM ({rows})"
                return f"SELECT {k}, _rn, {', '.join(made)} FROM ({rows})"

            same = " AND ".join(f's."{q}" IS NOT DISTINCT FROM r."{q}"' for q in keys)
            begin = f"SELECT {k}, _rn, {', '.join([*[f'{v} AS {names[q]}' for q, v in state.items()], *inputs])} FROM x{c} WHERE _rn = 1"
            given = [*[f's."{q}"' for q in keys], "s._rn", *[f"r.{n}" for n in names.values()], *[f"s.{x}" for x in inputs]]
            onward = f"SELECT {', '.join(given)} FROM s{c} r JOIN x{c} s ON s._rn = r._rn + 1 AND {same}"
            ctes.append(f"s{c} AS ({stepped(begin)} UNION ALL {stepped(onward)})")
            ctes.append(f"j{c} AS (SELECT s.*, r.* EXCLUDE ({k}, _rn) FROM {last} s JOIN s{c} r ON s._rn = r._rn AND {same})")
            last = f"j{c}"
            stored[n.key] = c
    out = ", ".join(f'{rounded(f"CAST({get(n)} AS DOUBLE)", digits)} AS "{name}"' for name, n in outputs.items())
    return f"WITH RECURSIVE {', '.join(ctes)} SELECT {k}, {o}, {out} FROM {last}"
