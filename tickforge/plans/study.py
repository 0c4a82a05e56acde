"""Studies: many operators planned together over the series of a table."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.registry import REGISTRY, categories
from .expr import E, topological
from .native import plan
from .tables import tos_stdevall, vp, zigzag

PRICES = ("open", "high", "low", "close", "volume")


@dataclass(frozen=True)
class Study:
    """A named list of operators: dicts of kind and parameters. `col_names` renames and `col_numbers` selects an
    operator's outputs; inputs are columns, or outputs of earlier entries of the study."""

    name: str
    ta: tuple[dict, ...]
    description: str = ""

    def __init__(self, name: str, ta, description: str = "") -> None:
        object.__setattr__(self, "name", name)
        object.__setattr__(self, "ta", tuple(dict(x) for x in ta))
        object.__setattr__(self, "description", description)

    def outputs(self, columns: dict[str, str] | None = None) -> dict[str, E]:
        out: dict[str, E] = {}
        for entry in self.ta:
            params = dict(entry)
            kind, names, numbers = params.pop("kind"), params.pop("col_names", None), params.pop("col_numbers", None)
            if kind not in REGISTRY:
                raise ValueError(f"no operator {kind!r}")
            op = REGISTRY[kind]
            for i in (*op.inputs, *op.optional):
                if params.get(i) in out:
                    params[i] = out[params[i]]
            new = op.outputs(columns, **params)
            if numbers is not None:
                new = dict(list(new.items())[n] for n in numbers)
            if names is not None:
                names = (names,) if isinstance(names, str) else names
                new = dict(zip(names, new.values(), strict=True))
            out |= new
        return out


COMMON = Study("Common", [*[{"kind": "sma", "length": n} for n in (10, 20, 50, 200)], {"kind": "sma", "close": "volume", "length": 20, "prefix": "VOL"}], "Price and volume averages")


def all_study(exclude: tuple[str, ...] = ("long_run", "short_run")) -> Study:
    """Every operator with its defaults, but those that need series of their own."""
    return Study("All", [{"kind": k} for k in sorted(REGISTRY) if k not in exclude], "All operators")


def category_study(category: str) -> Study:
    return Study(category, [{"kind": k} for k in categories()[category] if k not in ("long_run", "short_run")])


@dataclass(frozen=True)
class Bars:
    """A table of series: rows of one key in one order. `columns` maps operator inputs (open_, high, low, close,
    volume, ts) to columns; names match exactly, else without case."""

    df: DataFrame
    keys: tuple[str, ...] = ("symbol",)
    order: tuple[str, ...] = ("ts",)
    columns: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        present = {c.lower(): c for c in self.df.columns}
        missing = [c for c in (*self.keys, *self.order) if c not in self.df.columns]
        if missing:
            raise ValueError(f"no such columns: {', '.join(missing)}")
        found = {("open_" if p == "open" else p): present[p] for p in PRICES if p in present} | dict(self.columns)
        object.__setattr__(self, "columns", found)

    def prepared(self, outputs: dict[str, E]) -> tuple[DataFrame, dict[str, E]]:
        """The rows with the inputs of outputs as doubles (NaN as null), and the times of `ts` as epoch seconds."""
        used = {n.p[0] for out in outputs.values() for n in topological([out]) if n.op == "col"}
        present = {c.lower(): c for c in self.df.columns}
        new: dict[str, Column] = {}
        for name in used:
            if name == "ts":
                source = self.columns.get("ts", self.order[0])
                new["in__ts"] = (F.unix_micros(F.col(f"`{source}`").cast("timestamp")) / 1e6).cast("double")
                continue
            real = name if name in self.df.columns else present.get(name.lower())
            if real is None:
                raise ValueError(f"no column {name!r} in {self.df.columns}")
            x = F.col(f"`{real}`").cast("double")
            new[f"in__{name}"] = F.when(~F.isnan(x), x)
        made: dict[str, E] = {}

        def moved(n: E) -> E:
            if n.key not in made:
                made[n.key] = E("col", (), (f"in__{n.p[0]}",)) if n.op == "col" else E(n.op, tuple(moved(a) for a in n.args), n.p)
            return made[n.key]

        return self.df.withColumns(new) if new else self.df, {k: moved(v) for k, v in outputs.items()}

    def select(self, outputs: dict[str, E], keep: list[str] | None = None) -> DataFrame:
        df, moved = self.prepared(outputs)
        return plan(df, moved, list(self.keys), list(self.order), list(self.df.columns) if keep is None else keep)

    def adjusted(self, column: str) -> Bars:
        """These bars with another column as their close, such as one adjusted for dividends and splits."""
        return Bars(self.df, self.keys, self.order, {**self.columns, "close": column})

    def whole(self, kind: str, **params) -> DataFrame:
        """Operators over a whole series at once, which look ahead: tos_stdevall and zigzag append their columns, vp
        gives the profile's table."""
        keys, close = list(self.keys), self.columns.get("close", "close")
        if kind == "tos_stdevall":
            return tos_stdevall(self.df, keys, list(self.order), close, **params)
        if kind == "vp":
            return vp(self.df, keys, list(self.order), close, self.columns.get("volume", "volume"), **params)
        if kind == "zigzag":
            return zigzag(self.df, keys, self.order[0], self.columns.get("high", "high"), self.columns.get("low", "low"), **params)
        raise ValueError(f"{kind!r} is not an operator over whole series")

    def ta(self, kind: str, keep: list[str] | None = None, **params) -> DataFrame:
        """The table with an operator's columns appended (keep: only these of its own columns)."""
        if kind not in REGISTRY:
            raise ValueError(f"no operator {kind!r}")
        return self.select(REGISTRY[kind].outputs(self.columns, **params), keep)

    def study(self, study: Study | str | None = None, keep: list[str] | None = None) -> DataFrame:
        """A study, a category's name, or all operators, in one plan: series are brought together and sorted once,
        shared parts are computed once, and recursive operators share one Python pass."""
        study = all_study() if study is None else category_study(study) if isinstance(study, str) else study
        return self.select(study.outputs(self.columns), keep)


def speed_test(bars: Bars, only: list[str] | None = None, excluded: tuple[str, ...] = ("long_run", "short_run"), top: int | None = None, runs: int = 1):
    """Seconds of each operator alone over the bars, slowest first, as (kind, least, mean); top: only so many. Each
    result is computed in full and thrown away."""
    out = []
    for kind in sorted(only or REGISTRY):
        if kind in excluded:
            continue
        took = []
        for _ in range(runs):
            began = time.perf_counter()
            bars.ta(kind).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        out.append((kind, min(took), sum(took) / len(took)))
    return sorted(out, key=lambda r: -r[2])[:top]
