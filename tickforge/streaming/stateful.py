"""Operators with saved state: the same graphs as in batch, in Structured Streaming or resumed by hand."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..plans.expr import E
from ..plans.study import Bars, Study
from ..plans.vector import Running


def _values(running: Running, pdf: pd.DataFrame, inputs: list[str]) -> list[np.ndarray]:
    """The study's figures of new bars of one series, all bars at once."""
    return [v.astype(float) for v in running.step({c: pdf[c].to_numpy(dtype=float) for c in inputs})]


def _inputs(nodes: dict[str, E]) -> list[str]:
    from ..plans.expr import topological

    return sorted({n.p[0] for x in nodes.values() for n in topological([x]) if n.op == "col"})


class _Processor(StatefulProcessor):
    """Keeps, for each key, the graph's state and the last bar's time; bars not after it are dropped."""

    def __init__(self, nodes: dict[str, E], inputs: list[str], keys: list[str], order: str) -> None:
        self.nodes, self.inputs, self.keys, self.order = nodes, inputs, keys, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "graph string, last timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(self.order, kind="stable")
        running = Running(list(self.nodes.values()))
        if self.state.exists():
            saved, last = self.state.get()
            running.load(json.loads(saved))
            pdf = pdf[pdf[self.order] > pd.Timestamp(last)]
        pdf = pdf.drop_duplicates(self.order, keep="last")
        if not len(pdf):
            return
        out = pdf[[*self.keys, self.order]].reset_index(drop=True)
        for name, v in zip(self.nodes, _values(running, pdf, self.inputs), strict=True):
            out[name] = v
        self.state.update((json.dumps(running.save()), pdf[self.order].iloc[-1].to_pydatetime()))
        yield out

    def close(self) -> None:
        pass


def _planned(bars: Bars, study: Study) -> tuple[DataFrame, dict[str, E], list[str], str]:
    outputs = study.outputs(bars.columns)
    df, nodes = bars.prepared(outputs)
    inputs = _inputs(nodes)
    Running(list(nodes.values()))  # refuses operators that look ahead
    return df.select(*bars.keys, *bars.order, *inputs), nodes, inputs, bars.order[0]


def _schema(df: DataFrame, keys: list[str], order: str, nodes: dict[str, E]) -> str:
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return ", ".join([*[f"`{c}` {types[c]}" for c in (*keys, order)], *[f"`{n}` double" for n in nodes]])


def stream(bars: Bars, study: Study) -> DataFrame:
    """A streaming DataFrame of keys, time and the study's columns, in append mode. The state store must be RocksDB
    (`spark.sql.streaming.stateStore.providerClass`). State is bounded by the operators' windows."""
    df, nodes, inputs, order = _planned(bars, study)
    keys = list(bars.keys)
    return df.groupBy(*keys).transformWithStateInPandas(_Processor(nodes, inputs, keys, order), outputStructType=_schema(df, keys, order, nodes), outputMode="Append", timeMode="None")


def resume(bars: Bars, study: Study, state: DataFrame | None = None) -> DataFrame:
    """Batch counterpart: the study's columns of the given bars, going on from `state` (keys, last, graph), of which
    bars not after `last` are dropped. The last row of each key carries the new state in `graph`; state_of() takes it.
    One run over all bars and any number of resumed runs over their parts give the same values."""
    df, nodes, inputs, order = _planned(bars, study)
    keys = list(bars.keys)

    def run(key: tuple, new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        running = Running(list(nodes.values()))
        new = new.sort_values(order, kind="stable").drop_duplicates(order, keep="last")
        if len(old):
            running.load(json.loads(old["graph"].iloc[0]))
            new = new[new[order] > old["last"].iloc[0]]
        out = new[[*keys, order]].reset_index(drop=True)
        for name, v in zip(nodes, _values(running, new, inputs), strict=True):
            out[name] = v
        out["graph"] = None
        if len(out):
            out.loc[len(out) - 1, "graph"] = json.dumps(running.save())
        return out

    if state is None:
        state = df.select(*keys, F.col(order).alias("last"), F.lit("").alias("graph")).limit(0)
    return df.groupBy(*keys).cogroup(state.groupBy(*keys)).applyInPandas(run, _schema(df, keys, order, nodes) + ", graph string")


def state_of(result: DataFrame, keys: list[str], order: str, before: DataFrame | None = None) -> DataFrame:
    """The states that a resumed run left, with those of keys it did not see."""
    now = result.filter("graph is not null").select(*keys, F.col(order).alias("last"), "graph")
    return now if before is None else now.union(before.select(*keys, "last", "graph").join(now, keys, "left_anti"))
