"""The registry: every operator with its category, inputs and builder; its catalogue, and operators from outside."""

import importlib.util
import inspect
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from ..plans.expr import E, col, looks_ahead, recursive

BARS = ("open_", "high", "low", "close", "volume", "ts")


@dataclass(frozen=True)
class Operator:
    kind: str
    category: str
    build: Callable[..., dict[str, E]]
    inputs: tuple[str, ...]
    optional: tuple[str, ...] = ()
    defaults: dict = field(default_factory=dict)

    def outputs(self, columns: dict[str, str] | None = None, **params) -> dict[str, E]:
        """The operator's outputs by canonical name. columns: which column an input is read from; optional inputs
        are used only if a parameter names their column (or is True); unknown parameters are errors. Common modifiers:
        offset (rows to shift by), fillna, prefix, suffix."""
        offset, fillna = params.pop("offset", 0), params.pop("fillna", None)
        prefix, suffix = params.pop("prefix", None), params.pop("suffix", None)
        columns = dict(columns or {})
        extra = {}
        for name in self.optional:
            wanted = params.pop(name, None)
            if wanted is not None and wanted is not False:
                extra[name] = columns.get(name, name) if wanted is True else wanted
        for name in self.inputs:
            if name in params:
                columns[name] = params.pop(name)
        unknown = set(params) - set(self.defaults)
        if unknown:
            raise TypeError(f"{self.kind} has no parameter {', '.join(sorted(unknown))}")
        given = {n: _input(columns.get(n, n)) for n in self.inputs} | {n: _input(c) for n, c in extra.items()}
        out = self.build(**given, **params)
        if offset:
            out = {k: v.lag(offset) for k, v in out.items()}
        if fillna is not None:
            out = {k: E("coalesce", (v, E("lit", (), (float(fillna),)))) for k, v in out.items()}
        return {"_".join(x for x in (prefix, k, suffix) if x): v for k, v in out.items()}

    @property
    def lookahead(self) -> bool:
        return any(looks_ahead(n) for n in self.outputs({n: n for n in self.inputs}).values())

    @property
    def stateful(self) -> bool:
        return any(recursive(n) for n in self.outputs().values())


def _input(name):
    return name if isinstance(name, E) else col(name.removesuffix("_") if name == "open_" else name)


REGISTRY: dict[str, Operator] = {}


def operator(category: str, kind: str | None = None):
    """Registers a builder. Its parameters that are bar columns are inputs (optional ones default to None); the
    others are parameters. It gives {canonical name: expression}."""

    def put(build):
        params = inspect.signature(build).parameters.values()
        inputs = tuple(p.name for p in params if p.name in (*BARS, "fast_", "slow_") and p.default is inspect.Parameter.empty)
        optional = tuple(p.name for p in params if p.name in BARS and p.default is None)
        defaults = {p.name: p.default for p in params if p.name not in (*inputs, *optional)}
        name = kind or build.__name__.rstrip("_")
        REGISTRY[name] = Operator(name, category, build, inputs, optional, defaults)
        return build

    return put


def categories() -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for op in REGISTRY.values():
        out.setdefault(op.category, []).append(op.kind)
    return {k: sorted(v) for k, v in sorted(out.items())}


def search(text: str) -> list[str]:
    """Kinds whose name, category or documentation holds a text, in any case."""
    t = text.lower()
    return sorted(k for k, op in REGISTRY.items() if t in f"{k} {op.category} {op.build.__doc__ or ''}".lower())


def describe(kind: str) -> str:
    """An operator's category, inputs, parameters and outputs, and what its documentation says."""
    op = REGISTRY[kind]
    params = ", ".join(f"{k}={v!r}" for k, v in op.defaults.items())
    inputs = ", ".join([*op.inputs, *[f"{o} (optional)" for o in op.optional]])
    text = inspect.getdoc(op.build)
    lines = [f"{kind} ({op.category})", f"inputs: {inputs}", f"parameters: {params}", f"outputs: {', '.join(op.outputs())}"]
    return "\n".join(lines + ([text] if text else []))


def bind(category: str, kind: str, build: Callable[..., dict[str, E]]) -> Operator:
    """Registers an operator from outside under any category; its kind must be new."""
    if kind in REGISTRY:
        raise ValueError(f"there is an operator {kind!r}")
    operator(category, kind)(build)
    return REGISTRY[kind]


def import_directory(path: str) -> list[str]:
    """Registers the operators of a folder with a subfolder for each category. A file `<category>/<kind>.py` defines a
    function of the kind's name, and may define kernels. Returns the kinds; a file without its function is an error."""
    kinds = []
    for file in sorted(Path(path).glob("*/*.py")):
        if file.name.startswith("_"):
            continue
        spec = importlib.util.spec_from_file_location(f"tickforge_plugin_{file.parent.name}_{file.stem}", file)
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
        build = getattr(module, file.stem, None)
        if not callable(build):
            raise ValueError(f"{file} defines no {file.stem}()")
        bind(file.parent.name, file.stem, build)
        kinds.append(file.stem)
    return kinds
