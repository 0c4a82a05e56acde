"""Series operators: independent formulas, batch against bar by bar, SQL, keys, edges and look-ahead."""

import datetime
import json
import math
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
import tickforge.operators  # noqa: F401
from pyspark.sql import functions as F
from tickforge.functions import series as s
from tickforge.operators.registry import REGISTRY, categories
from tickforge.plans.expr import E, Stepper, col, cum, scan, topological
from tickforge.plans.queries import OUTPUTS, QUERIES, WHOLE, oracles
from tickforge.plans.sql import NotInSQL, sql
from tickforge.plans.study import COMMON, Bars, Study, all_study, category_study
from tickforge.plans.vector import Running, evaluate
from tickforge.streaming.stateful import resume, state_of


def bars(n=400, seed=7, symbols=("a",), nulls=False):
    r = np.random.default_rng(seed)
    parts = []
    for k in symbols:
        c = 100 + r.normal(size=n).cumsum()
        o = c + r.normal(size=n) * 0.2
        v = r.integers(100, 1000, n).astype(float)
        p = pd.DataFrame({"symbol": k, "ts": pd.date_range("2025-01-01", periods=n, freq="h"), "open": o, "high": np.maximum(o, c) + r.random(n) * 0.5, "low": np.minimum(o, c) - r.random(n) * 0.5, "close": c, "volume": v})
        if nulls:
            p.loc[r.choice(n, 12, replace=False), ["open", "high", "low", "close", "volume"]] = np.nan
        parts.append(p)
    return pd.concat(parts, ignore_index=True)


def columns(pdf):
    return {c: pdf[c].to_numpy(dtype=float) for c in ("open", "high", "low", "close", "volume")} | {"ts": pdf["ts"].astype("int64").to_numpy() / 1e9}


def run(kind, pdf, **params):
    out = REGISTRY[kind].outputs(**params)
    return dict(zip(out, evaluate(list(out.values()), columns(pdf), {}), strict=True))


def close_to(a, b, tol=1e-8):
    a, b = np.asarray(a, dtype=float), np.asarray(b, dtype=float)
    assert (np.isnan(a) == np.isnan(b)).all(), (np.flatnonzero(np.isnan(a) != np.isnan(b))[:5], a[:20], b[:20])
    assert np.allclose(a, b, rtol=tol, atol=tol, equal_nan=True)


def ema(x, n):
    x = x.copy()
    x.iloc[n - 1] = x.iloc[:n].mean()
    x.iloc[: n - 1] = np.nan
    return x.ewm(span=n, adjust=False).mean()


def outputs_of(kind):
    return OUTPUTS[f"{kind}_to_date" if kind in WHOLE else kind]


PDF = bars()
O, H, L, C, V = (PDF[c] for c in ("open", "high", "low", "close", "volume"))
TP = (H + L + C) / 3
TR = pd.concat([H - L, (H - C.shift()).abs(), (C.shift() - L).abs()], axis=1).max(axis=1)


def atr(n):
    t = TR.copy()
    t.iloc[n - 1] = t.iloc[:n].mean()
    t.iloc[: n - 1] = np.nan
    return t.ewm(alpha=1 / n, adjust=False).mean()


def rsi(x, n):
    d = x.diff()
    p, q = d.clip(lower=0).ewm(alpha=1 / n, adjust=False).mean(), (-d.clip(upper=0)).ewm(alpha=1 / n, adjust=False).mean()
    return 100 * p / (p + q)


def wma(x, n):
    return x.rolling(n).apply(lambda w: np.dot(w, np.arange(1, n + 1)) / (n * (n + 1) / 2), raw=True)


def psar():
    """Written from the rules: trail by a growing share of the way to the extreme, flip when touched."""
    h, low, out = H.tolist(), L.tolist(), []
    down = (low[0] - low[1]) > (h[1] - h[0]) and low[0] > low[1]
    stop, extreme, step = (h[0] if down else low[0]), (low[0] if down else h[0]), 0.02
    for i in range(1, len(h)):
        stop += step * (extreme - stop)
        hit = h[i] > stop if down else low[i] < stop
        if (low[i] < extreme) if down else (h[i] > extreme):
            extreme, step = (low[i] if down else h[i]), min(step + 0.02, 0.2)
        stop = max(h[i - 1], stop) if down else min(low[i - 1], stop)
        if hit:
            stop, down, step = extreme, not down, 0.02
            extreme = low[i] if down else h[i]
        out.append((np.nan if down else stop, stop if down else np.nan))
    return [np.nan, *[a for a, _ in out]], [np.nan, *[b for _, b in out]]


def supertrend(n=7, k=3.0):
    a, mid, c = atr(n), (H + L) / 2, C.tolist()
    lo, up, d, out = (mid - k * a).tolist(), (mid + k * a).tolist(), 1, [np.nan]
    for i in range(1, len(c)):
        if c[i] > up[i - 1]:
            d = 1
        elif c[i] < lo[i - 1]:
            d = -1
        elif d > 0:
            lo[i] = lo[i - 1] if lo[i] < lo[i - 1] else lo[i]
        else:
            up[i] = up[i - 1] if up[i] > up[i - 1] else up[i]
        out.append(lo[i] if d > 0 else up[i])
    return out


def macd():
    m = ema(C, 12) - ema(C, 26)
    tail = ema(m.iloc[25:], 9)
    return m, tail.reindex(m.index)


def stoch_k(n):
    lo, hi = L.rolling(n).min(), H.rolling(n).max()
    return 100 * (C - lo) / (hi - lo)


FORMULAS = {
    "SMA_10": ("sma", lambda: C.rolling(10).mean()), "EMA_10": ("ema", lambda: ema(C, 10)), "RMA_10": ("rma", lambda: C.ewm(alpha=0.1, adjust=False).mean()), "WMA_10": ("wma", lambda: wma(C, 10)),
    "DEMA_10": ("dema", lambda: 2 * ema(C, 10) - ema(C, 10).ewm(span=10, adjust=False).mean()), "RSI_14": ("rsi", lambda: rsi(C, 14)), "ATRr_14": ("atr", lambda: atr(14)), "MACD_12_26_9": ("macd", lambda: macd()[0]), "MACDs_12_26_9": ("macd", lambda: macd()[1]),
    "BBU_5_2.0_2.0": ("bbands", lambda: C.rolling(5).mean() + 2 * C.rolling(5).std()), "STOCHd_14_3_3": ("stoch", lambda: stoch_k(14).rolling(3).mean().rolling(3).mean()), "OBV": ("obv", lambda: (np.sign(C.diff()).fillna(1) * V).cumsum()),
    "PSARl_0.02_0.2": ("psar", lambda: psar()[0]), "PSARs_0.02_0.2": ("psar", lambda: psar()[1]), "SUPERT_7_3.0": ("supertrend", supertrend), "CCI_14_0.015": ("cci", lambda: (TP - TP.rolling(14).mean()) / (0.015 * TP.rolling(14).apply(lambda w: np.abs(w - w.mean()).mean(), raw=True))),
    "LINREG_14": ("linreg", lambda: C.rolling(14).apply(lambda w: np.polyval(np.polyfit(np.arange(14), w, 1), 13), raw=True)), "CTI_12": ("cti", lambda: C.rolling(12).apply(lambda w: np.corrcoef(w, np.arange(12))[0, 1], raw=True)),
    "KURT_30": ("kurtosis", lambda: C.rolling(30).kurt()), "SKEW_30": ("skew", lambda: C.rolling(30).skew()), "MEDIAN_30": ("median", lambda: C.rolling(30).median()), "ZS_30": ("zscore", lambda: (C - C.rolling(30).mean()) / C.rolling(30).std()),
    "AROONU_14": ("aroon", lambda: H.rolling(15).apply(lambda w: 100 * (1 - (14 - (14 - np.argmax(w[::-1]))) / 14), raw=True)), "VWMA_10": ("vwma", lambda: (C * V).rolling(10).mean() / V.rolling(10).mean()), "K_9_3": ("kdj", lambda: stoch_k(9).ewm(alpha=1 / 3, min_periods=3).mean()),
    "ER_10": ("er", lambda: (C - C.shift(10)).abs() / C.diff().abs().rolling(10).sum()), "TRIX_30_9": ("trix", lambda: 100 * ema(C, 30).ewm(span=30, adjust=False).mean().ewm(span=30, adjust=False).mean().pct_change()), "DD": ("drawdown", lambda: C.cummax() - C),
    "WILLR_14": ("willr", lambda: 100 * ((C - L.rolling(14).min()) / (H.rolling(14).max() - L.rolling(14).min()) - 1)), "MFI_14": ("mfi", lambda: mfi(14)), "SMMA_7": ("smma", lambda: smma(7)), "HMA_10": ("hma", lambda: wma(2 * wma(C, 5) - wma(C, 10), 3)),
    "PVI": ("pvi", lambda: 100 * (C / C.shift()).where(V > V.shift(), 1.0).cumprod()), "VHF_28": ("vhf", lambda: (C.rolling(28).max() - C.rolling(28).min()) / C.diff().abs().rolling(28).sum()), "ALMA_9_6.0_0.85": ("alma", lambda: alma()),
}


def mfi(n):
    raw, d = TP * V, TP.diff()
    p, q = raw.where(d > 0, 0.0), raw.where(d <= 0, 0.0)
    p.iloc[0] = q.iloc[0] = np.nan
    p, q = p.rolling(n).sum(), q.rolling(n).sum()
    return 100 * p / (p + q)


def smma(n):
    x, y = C.tolist(), [np.nan] * (n - 1) + [C.iloc[:n].mean()]
    for v in x[n:]:
        y.append(((n - 1) * y[-1] + v) / n)
    return y


def alma():
    w = np.exp(-((np.arange(9) - 6) ** 2) / (2 * 1.5**2))
    return C.rolling(9).apply(lambda x: np.dot(x, w) / w.sum(), raw=True)


@pytest.mark.parametrize("name", FORMULAS)
def test_formula(name):
    kind, formula = FORMULAS[name]
    close_to(run(kind, PDF)[name], formula(), 1e-7)


def test_catalogue():
    assert len(REGISTRY) == 157 and set(categories()) == {"candle", "cycle", "momentum", "overlap", "performance", "statistics", "trend", "volatility", "volume"}
    with pytest.raises(TypeError):
        REGISTRY["ema"].outputs(lenght=3)


def test_optional_inputs_are_used_only_if_named(many):
    b = Bars(many)
    assert "AD" in b.ta("ad").columns and "ADo" in b.ta("ad", open_=True).columns
    assert "RVIr_14" in b.ta("rvi", high=True, low=True, refined=True).columns
    with pytest.raises(ValueError, match="take high and low"):
        b.ta("rvi", refined=True)


def test_utilities():
    assert s.combination(10, 4) == 210 and s.combination(10, 4, repetition=True) == 715 and s.pascal(5) == [1, 4, 6, 4, 1] and s.triangle(5) == [1, 2, 3, 2, 1]
    assert s.fibonacci(6) == [1, 1, 2, 3, 5, 8] and s.zero(1e-17) == 0 and s.zero(1e-15) != 0 and len(s.ma()) == 17


@pytest.mark.parametrize("kind", sorted(REGISTRY))
def test_bar_by_bar_equals_batch_over_a_saved_state(kind):
    pdf = bars(220, 11)
    out = outputs_of(kind)
    whole = evaluate(list(out.values()), columns(pdf), {})
    cut = random.Random(kind).randrange(5, 215)
    rows = pd.DataFrame(columns(pdf)).to_dict("records")
    first = Stepper(list(out.values()))
    values = [first.step(r) for r in rows[:cut]]
    second = Stepper(list(out.values()))
    second.load(json.loads(json.dumps(first.save())))
    values += [second.step(r) for r in rows[cut:]]
    for i in range(len(out)):
        close_to([float(v[i]) for v in values], whole[i], 1e-6)


@pytest.mark.parametrize("kind", sorted(REGISTRY))
def test_parts_equal_batch_over_a_saved_state(kind):
    """Cut at random into parts of any length, one bar among them, with missing bars."""
    pdf = bars(220, 12, nulls=True)
    out = list(outputs_of(kind).values())
    given = columns(pdf)
    whole = evaluate(out, given, {})
    r = random.Random(kind)
    cuts = sorted({0, 220, 1, *(r.randrange(220) for _ in range(4))})
    parts, saved = [], None
    for a, b in zip(cuts, cuts[1:], strict=False):
        running = Running(out)
        if saved is not None:
            running.load(json.loads(saved))
        parts.append(running.step({k: v[a:b] for k, v in given.items()}))
        saved = json.dumps(running.save())
    for i in range(len(out)):
        close_to(np.concatenate([p[i].astype(float) for p in parts]), whole[i], 1e-6)


@pytest.mark.parametrize("kind", sorted(REGISTRY))
def test_nothing_looks_ahead_by_default(kind):
    pdf = bars(200, 5)
    out = outputs_of(kind)
    whole, part = (evaluate(list(out.values()), columns(x), {}) for x in (pdf, pdf.iloc[:150]))
    for a, b in zip(whole, part, strict=True):
        close_to(a[:150], b, 1e-9)


def test_look_ahead_is_refused_on_streams():
    for kind, params in (("dpo", {"centered": True}), ("ichimoku", {"include_chikou": True})):
        out = REGISTRY[kind].outputs(**params)
        for make in (Stepper, Running):
            with pytest.raises(ValueError, match="looks ahead"):
                make(list(out.values()))


@pytest.mark.parametrize("fixture", ["flat", "short", "up", "down", "nulls", "zero"])
def test_edges(fixture):
    pdf = bars(60, 3, nulls=fixture == "nulls")
    if fixture in ("flat", "zero"):
        pdf[["open", "high", "low", "close", "volume"]] = 5.0 if fixture == "flat" else 0.0
    if fixture == "short":
        pdf = pdf.iloc[:2]
    if fixture in ("up", "down"):
        step = np.arange(60.0) if fixture == "up" else 100 - np.arange(60.0)
        pdf["open"], pdf["close"], pdf["high"], pdf["low"] = step, step, step + 0.5, step - 0.5
    for kind, out in OUTPUTS.items():
        for name, v in zip(out, evaluate(list(out.values()), columns(pdf), {}), strict=True):
            assert len(v) == len(pdf) and not np.isinf(v.astype(float)).any(), (kind, name)
    if fixture == "up":
        assert np.nanmin(run("rsi", pdf)["RSI_14"]) == 100


def table(spark, pdf):
    rows = [(r.symbol, r.ts.to_pydatetime(), *(None if math.isnan(x) else float(x) for x in (r.open, r.high, r.low, r.close, r.volume))) for r in pdf.itertuples(index=False)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double")


@pytest.fixture(scope="module")
def many(spark):
    return table(spark, bars(260, 9, ("a", "b", "c"))).repartition(4).cache()


def test_study_over_many_series_equals_each_alone(many):
    pdf = bars(260, 9, ("a", "b", "c"))
    study = Study("mixed", [{"kind": k} for k in ("ema", "rsi", "macd", "supertrend", "aroon", "kama", "adx", "vwap", "pivots", "bbands", "ha", "qqe", "kdj", "exhc", "alphatrend", "zigzag")])
    got = Bars(many).study(study).toPandas().sort_values(["symbol", "ts"])
    out = study.outputs()
    assert list(got.columns) == [*pdf.columns, *out]
    for k in "abc":
        mine, theirs = got[got.symbol == k], pdf[pdf.symbol == k].reset_index(drop=True)
        for name, v in zip(out, evaluate(list(out.values()), columns(theirs), {}), strict=True):
            close_to(mine[name].to_numpy(dtype=float), v, 1e-6)


def test_true_and_false_cross_the_pass(many):
    """Comparisons before, in and after recursive nodes, alone in a plan."""
    pdf = bars(260, 9, ("a", "b", "c"))
    for kind in ("kdj", "zigzag", "alphatrend", "atrts", "macd"):
        got = Bars(many).ta(kind, ["symbol", "ts"]).toPandas().sort_values(["symbol", "ts"])
        mine = got[got.symbol == "b"]
        for name, v in run(kind, pdf[pdf.symbol == "b"].reset_index(drop=True)).items():
            close_to(mine[name].to_numpy(dtype=float), v, 1e-6)


def test_one_python_pass_and_one_exchange(many):
    df = Bars(many).study(Study("s", [{"kind": k} for k in ("ema", "rsi", "macd", "adx", "supertrend", "sma")]))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1
    many.sparkSession.conf.set("spark.sql.adaptive.enabled", "false")
    physical = Bars(many).study(Study("s", [{"kind": k} for k in ("ema", "rsi", "adx", "sma")]))._jdf.queryExecution().executedPlan().toString()
    many.sparkSession.conf.set("spark.sql.adaptive.enabled", "true")
    # By key once for the windows that feed the pass and once into it; the cached bars' own exchange is below the cache.
    assert physical.split("InMemoryTableScan")[0].count("Exchange hashpartitioning") <= 2, physical


def test_native_operators_run_no_python(many):
    for kind in ("sma", "aroon", "obv", "stoch", "linreg", "vwap", "kurtosis", "pivots"):
        assert "InPandas" not in Bars(many).ta(kind)._jdf.queryExecution().optimizedPlan().toString(), kind


def test_long_series_go_on_in_parts(spark, monkeypatch):
    from tickforge.plans import native

    long = table(spark, bars(3300, 9, ("a", "b"))).repartition(3).cache()
    study = Study("s", [{"kind": k} for k in ("adx", "kdj", "supertrend", "vwap", "rsx", "aroon")])
    want = Bars(long).study(study, ["symbol", "ts"]).toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)
    monkeypatch.setattr(native, "PART_BYTES", 1)  # parts of 1000 rows and more
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "137")
    got = Bars(long).study(study, ["symbol", "ts"]).toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    pd.testing.assert_frame_equal(got, want)


def test_sql_equals_spark_and_arrays():
    pdf = bars(150, 13, ("a", "b"))
    con = duckdb.connect()
    con.register("bars", pdf)
    done = 0
    for kind in sorted(REGISTRY):
        out = outputs_of(kind)
        if any(n.op == "col" and n.p[0] == "ts" for x in out.values() for n in topological([x])):
            continue
        try:
            query = sql("SELECT * FROM bars", out, ["symbol"], ["ts"])
        except NotInSQL:
            continue
        got = con.sql(query).df().sort_values(["symbol", "ts"])
        for k in "ab":
            theirs = pdf[pdf.symbol == k].reset_index(drop=True)
            for name, v in zip(out, evaluate(list(out.values()), columns(theirs), {}), strict=True):
                big = np.abs(np.nan_to_num(v)).max()
                close_to(got[got.symbol == k][name].to_numpy(dtype=float), v, 1e-5 if big < 1e4 else 1e-2 if big < 1e8 else 50)
        done += 1
    assert done >= 155


def test_every_query_has_sql():
    assert set(oracles()) == set(QUERIES) and len(QUERIES) > 190


def test_resume_in_parts_equals_one_run(spark):
    pdf = bars(120, 21, ("a", "b"))
    study = Study("s", [{"kind": k} for k in ("ema", "rsi", "adx", "supertrend", "sma", "obv", "psar")])
    b = lambda x: Bars(table(spark, x))
    want = resume(b(pdf), study).drop("graph").toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)
    cut = pdf["ts"].unique()[70]
    first = resume(b(pdf[pdf.ts <= cut]), study).cache()
    late = pdf[(pdf.ts > cut) | (pdf.ts == pdf["ts"].min())]  # an old bar comes again
    second = resume(b(late), study, state_of(first, ["symbol"], "ts"))
    got = pd.concat([first.drop("graph").toPandas(), second.drop("graph").toPandas()]).sort_values(["symbol", "ts"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want)


def test_stream_equals_batch(spark, tmp_path):
    from tickforge.streaming.stateful import stream

    pdf = bars(90, 22, ("a", "b"))
    study = Study("s", [{"kind": k} for k in ("ema", "rsi", "atr", "sma", "supertrend")])
    want = resume(Bars(table(spark, pdf)), study).drop("graph").toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)
    source = str(tmp_path / "in")
    times = sorted(pdf["ts"].unique())
    for lo, hi in ((0, 40), (40, 65), (65, 90)):
        table(spark, pdf[pdf.ts.isin(times[lo:hi])]).coalesce(1).write.mode("append").parquet(source)
    live = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(source)
    q = stream(Bars(live), study).writeStream.format("memory").queryName("out_series").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = spark.sql("select * from out_series").toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want)


def test_modifiers_and_chaining(many):
    b = Bars(many)
    got = b.ta("sma", ["symbol", "ts", "close"], length=3, offset=2, fillna=0.0, prefix="P", suffix="S").toPandas().sort_values(["symbol", "ts"])
    a = got[got.symbol == "a"]
    close_to(a["P_SMA_3_S"], a["close"].rolling(3).mean().shift(2).fillna(0.0))
    got = b.study(Study("x", [{"kind": "ema"}, {"kind": "sma", "close": "EMA_10", "length": 4, "col_names": "chain"}, {"kind": "macd", "col_numbers": (0,)}]), ["symbol", "ts", "close"]).toPandas()
    assert list(got.columns) == ["symbol", "ts", "close", "EMA_10", "chain", "MACD_12_26_9"]
    assert "VOL_SMA_20" in b.study(COMMON).columns
    with pytest.raises(ValueError, match="no column"):
        b.ta("sma", close="nothing")
    assert len(all_study().outputs()) > 250 and all(category_study(c).outputs() for c in categories())


def test_vwap_anchor_and_pivots_use_full_periods():
    got = run("vwap", PDF)["VWAP_D"]
    day = PDF["ts"].dt.date
    close_to(got, (TP * V).groupby(day).cumsum() / V.groupby(day).cumsum())
    d = PDF.groupby(day).agg(h=("high", "max"), l=("low", "min"), c=("close", "last")).shift(1)
    close_to(run("pivots", PDF)["PIVOTS_TRAD_D_P"], ((d.h + d.l + d.c) / 3).reindex(day).to_numpy())


def test_tables(spark):
    from tickforge.plans.tables import tos_stdevall, vp

    pdf = bars(57, 4, ("a", "b"))
    df = table(spark, pdf)
    got = tos_stdevall(df, ["symbol"], ["ts"]).toPandas().sort_values(["symbol", "ts"])
    a = pdf[pdf.symbol == "a"]["close"]
    close_to(got[got.symbol == "a"]["TOS_STDEVALL_LR"], np.polyval(np.polyfit(np.arange(57), a, 1), np.arange(57)))
    got = vp(df, ["symbol"], ["ts"]).toPandas().sort_values(["symbol", "bucket"])
    chunks = np.array_split(pdf[pdf.symbol == "a"]["volume"].to_numpy(), 10)
    flat = pdf[pdf.symbol == "a"]["close"].diff().fillna(1.0).eq(0).to_numpy()
    quiet = np.array_split(np.where(flat, pdf[pdf.symbol == "a"]["volume"].to_numpy(), 0.0), 10)
    close_to(got[got.symbol == "a"]["total_volume"], [c.sum() - q.sum() for c, q in zip(chunks, quiet, strict=True)])
    b = Bars(df)
    assert b.whole("vp").count() == 20 and "TOS_STDEVALL_U_3" in b.whole("tos_stdevall").columns and "TOS_STDEVALL_LR" in b.ta("tos_stdevall").columns
    with pytest.raises(ValueError, match="whole series"):
        b.whole("ema")


def test_profile_total_leaves_out_unchanged_closes(spark):
    from tickforge.plans.tables import vp

    df = spark.createDataFrame([("a", i, x, 10.0) for i, x in enumerate([5.0, 6.0, 6.0, 4.0])], "symbol string, ts int, close double, volume double")
    (row,) = vp(df, ["symbol"], ["ts"], width=1).collect()
    assert (row.pos_volume, row.neg_volume, row.neut_volume, row.total_volume) == (20.0, 10.0, 10.0, 30.0)


def test_zigzag_with_hindsight(spark):
    path = [100, 102, 104, 106, 108, 110, 107, 104, 101, 98, 95, 97, 99, 101, 103, 105, 104, 103, 104, 105, 111, 117, 112, 107, 102, 99, 100, 101, 102, 103]
    df = spark.createDataFrame([("a", i, float(x) + 0.5, float(x) - 0.5) for i, x in enumerate(path)], "symbol string, ts int, high double, low double")
    got = Bars(df).whole("zigzag", legs=4, deviation=8.0).collect()
    points = sorted((r.ts, r["ZIGZAGs_8.0%_4"], r["ZIGZAGv_8.0%_4"], round(r["ZIGZAGd_8.0%_4"], 6)) for r in got if r["ZIGZAGs_8.0%_4"])
    assert len(got) == len(path) and [p[:3] for p in points] == [(5, 1.0, 110.5), (10, -1.0, 94.5), (21, 1.0, 117.5), (25, -1.0, 98.5)]
    assert points[-1][3] == round(100 * (117.5 - 98.5) / 117.5, 6) and points[0][3] == 0


def test_frame_helpers(spark, tmp_path):
    from tickforge.functions import frames
    from tickforge.sources.bars import read_csv

    pdf = bars(40, 4, ("a", "b"))
    df = table(spark, pdf)
    now = F.lit("2025-01-02 12:00:00").cast("timestamp")
    assert frames.to_date(df, "ts", "month", now).count() == 80 and frames.to_date(df, "ts", "day", now).count() == 32
    assert frames.on_dates(df, "ts", ["2025-01-01"]).count() == 48 and frames.on_dates(df, "ts", []).count() == 0
    shuffled = df.withColumn("_row", F.when(F.col("symbol") == "a", F.unix_micros("ts")).otherwise(-F.unix_micros("ts")))
    assert {r.symbol: r.ordered for r in frames.ordered(shuffled, ["symbol"], "ts").collect()} == {"a": True, "b": False}
    one = frames.constants(df, [0, 50.5]).first()
    assert one["0"] == 0.0 and one["50.5"] == 50.5 and frames.constants(frames.constants(df, [1]), [1], append=False).columns == df.columns
    stamp = spark.range(1).select(frames.from_millis(F.lit(1735689600000)).alias("m"), frames.to_utc(F.lit("2025-01-01 00:00:00").cast("timestamp"), "America/New_York").alias("u")).first()
    assert str(stamp.m) == "2025-01-01 00:00:00" and str(stamp.u) == "2025-01-01 05:00:00"
    assert [r.ts for r in frames.reverse(df.filter("symbol = 'a'"), ["ts"]).collect()] == sorted(pdf["ts"].unique(), reverse=True)
    assert frames.simplify_columns(spark.createDataFrame([(1, 2)], "BBL_5 int, kcu_x int")) == ["l", "u"]
    assert "s)" in frames.final_time(0.0) and frames.get_time("nyse", datetime.datetime(2025, 1, 2, 12, tzinfo=datetime.UTC)).startswith("Thursday January 2, 2025, NYSE: 07:00:00, day 2/365")
    df.filter("symbol = 'a'").drop("symbol").coalesce(1).write.csv(str(tmp_path / "csv"), header=True)
    assert read_csv(spark, str(tmp_path / "csv")).agg(F.sum("close")).first()[0] == pytest.approx(pdf[pdf.symbol == "a"]["close"].sum())
    errors = {r["column"]: r for r in frames.error_analysis(df, df.withColumn("close", F.col("close") + 1), ["symbol", "ts"], ["open", "close"]).collect()}
    assert errors["open"].max_abs == 0 and errors["close"].mean_abs == pytest.approx(1) and errors["close"].correlation == pytest.approx(1) and errors["close"]["rows"] == 80
    means = spark.createDataFrame([(2.0, 0.0, -1.5), (8.0, 3.0, 4.0)], "x double, y double, z double").select(
        frames.geometric_mean(F.col("x")).alias("x"), frames.geometric_mean(F.col("y")).alias("y"), frames.geometric_mean(F.col("z")).alias("z"),
        frames.log_geometric_mean(F.col("x")).alias("l"), frames.log_geometric_mean(F.col("z")).alias("n"),
    ).first()
    assert means.x == pytest.approx(4) and means.y == pytest.approx(1) and means.z == 0 and means.l == pytest.approx(math.sqrt(27) - 1) and means.n == 0


def test_math_helpers():
    assert s.horner([4, -3, 0, 1], -6.5) == -1224.25 and s.erf(0.5) == math.erf(0.5) and s.strided_window([1, 2, 3, 4], 3) == [[1, 2, 3], [2, 3, 4]]
    rose, fell = (evaluate([x], {"close": np.array([1.0, 2.0, 2.0, 1.0])}, {})[0].tolist() for x in s.unsigned_differences(col("close")))
    assert rose == [0, 1, 0, 0] and fell == [0, 0, 0, 1]


def test_catalogue_search_and_plug_ins(tmp_path, many):
    from tickforge.operators.registry import REGISTRY, bind, describe, import_directory, search

    assert "rsx" in search("momentum") and "zigzag" in search("repaints") and "parameters: length=14" in describe("rsi") and "RSI_14" in describe("rsi")
    (tmp_path / "mine").mkdir()
    (tmp_path / "mine" / "double_sma.py").write_text(
        "from tickforge.functions.series import sma\nfrom tickforge.operators.kernels import Kernel, kernel\nfrom tickforge.plans.expr import scan\n\n\n"
        "@kernel\nclass running_best(Kernel):\n    def step(self, x):\n        self.s['y'] = max(x, self.s.get('y', x))\n        return (self.s['y'],)\n\n\n"
        "def double_sma(close, length=3):\n    return {f'DSMA_{length}': 2.0 * sma(close, length), 'BEST': scan('running_best', [close])[0]}\n"
    )
    try:
        assert import_directory(str(tmp_path)) == ["double_sma"] and "double_sma" in categories()["mine"]
        rows = Bars(many).ta("double_sma", ["symbol", "ts", "close"], length=4).toPandas().sort_values(["symbol", "ts"])
        a = rows[rows.symbol == "a"]
        close_to(a["DSMA_4"], 2 * a["close"].rolling(4).mean())
        close_to(a["BEST"], a["close"].cummax())
        with pytest.raises(ValueError, match="there is an operator"):
            bind("mine", "ema", lambda close: {})
    finally:
        REGISTRY.pop("double_sma", None)


def test_adjusted_close_and_speed(many):
    from tickforge.plans.study import speed_test

    b = Bars(many.withColumn("adj", F.col("close") * 2)).adjusted("adj")
    rows = b.ta("sma", ["symbol", "ts", "close"], length=2).toPandas().sort_values(["symbol", "ts"])
    a = rows[rows.symbol == "a"]
    close_to(a["SMA_2"], 2 * a["close"].rolling(2).mean())
    timed = speed_test(Bars(many), only=["sma", "ema"], top=1)
    assert len(timed) == 1 and timed[0][0] in ("sma", "ema") and timed[0][1] > 0


def test_signals_and_seeds():
    out = run("rsi", PDF, signal_indicators=True, xa=60, xb=40, xseries="open")
    assert list(out) == ["RSI_14", "RSI_14_A_60", "RSI_14_B_40", "RSI_14_XA_open", "RSI_14_XB_open"]
    assert (out["RSI_14_A_60"] == (out["RSI_14"] >= 60)).all()
    d = C.diff()
    want = [np.nan] * 14
    p, q = d.clip(lower=0).iloc[1:15].mean(), (-d.clip(upper=0)).iloc[1:15].mean()
    want.append(100 * p / (p + q))
    for x in d.iloc[15:]:
        p, q = (13 * p + max(x, 0)) / 14, (13 * q + max(-x, 0)) / 14
        want.append(100 * p / (p + q))
    close_to(run("rsi", PDF, seed="sma")["RSI_14"], want)
    e1 = ema(C, 10)
    e2 = ema(e1.iloc[9:].reset_index(drop=True), 10).reindex(range(-9, len(C) - 9)).reset_index(drop=True)
    close_to(run("dema", PDF, seed="sma")["DEMA_10"], 2 * e1 - e2)
    x = run("rsi", PDF)["RSI_14"]
    from tickforge.functions import signals as sig

    both = sig.xsignals(col("x"), 50, 50)
    got = dict(zip(both, evaluate(list(both.values()), {"x": x}, {}), strict=True))
    assert (got["XS_LONG"] + got["XS_SHORT"] == 1).all() and (got["XS_LONG"] == got["TS_Trends"]).all()


def test_every_operator_streams(spark, tmp_path):
    """All operators at once through a stream in three batches, against one batch run of their graphs."""
    from tickforge.streaming.stateful import stream

    pdf = bars(75, 23, ("a", "b"))
    study = all_study()
    source, times = str(tmp_path / "in"), sorted(pdf["ts"].unique())
    for lo, hi in ((0, 33), (33, 34), (34, 75)):
        table(spark, pdf[pdf.ts.isin(times[lo:hi])]).coalesce(1).write.mode("append").parquet(source)
    live = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", 1).parquet(source)
    q = stream(Bars(live), study).writeStream.format("memory").queryName("all_series").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = spark.sql("select * from all_series").toPandas().sort_values(["symbol", "ts"])
    out = study.outputs()
    assert len(got) == 150 and len({k for k in out}) > 280
    for k in "ab":
        theirs = pdf[pdf.symbol == k].reset_index(drop=True)
        for name, v in zip(out, evaluate(list(out.values()), columns(theirs), {}), strict=True):
            close_to(got[got.symbol == k][name].to_numpy(dtype=float), v, 1e-6)


def test_bars_of_a_stream_wait_for_the_watermark(spark, tmp_path):
    from tickforge.sources.bars import stream_bars

    at = lambda h, m: datetime.datetime(2025, 1, 1, h, m)
    batches = [[("a", at(0, 5), 1.0, 1), ("a", at(0, 50), 3.0, 2), ("a", at(1, 10), 2.0, 3)], [("a", at(0, 20), 9.0, 4), ("a", at(2, 30), 4.0, 5)]]
    # Spark drops by the watermark of the batch before.
    batches += [[("a", at(2, 40), 6.0, 6)], [("a", at(0, 30), 99.0, 7), ("a", at(5, 0), 5.0, 8)]]
    for rows in batches:
        spark.createDataFrame(rows, "k string, ts timestamp, price double, id int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live = spark.readStream.schema("k string, ts timestamp, price double, id int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream_bars(live, "k", "ts", "price", "1 hour", "1 hour", ["id"]).writeStream.format("memory").queryName("live_bars").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        dropped = sum(int(o["numRowsDroppedByWatermark"]) for p in q.recentProgress for o in json.loads(p.json)["stateOperators"])
    finally:
        q.stop()
    got = {r.ts.hour: (r.open, r.high, r.low, r.close, r.volume) for r in spark.sql("select * from live_bars").collect()}
    assert got == {0: (1.0, 9.0, 1.0, 3.0, 3.0), 1: (2.0, 2.0, 2.0, 2.0, 1.0), 2: (4.0, 6.0, 4.0, 6.0, 2.0)} and dropped == 1


def test_generator_is_the_same_for_a_seed(spark):
    from tickforge.sources.bars import generate

    a, b = (generate(spark, 50, 3, 2).repartition(n).toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True) for n in (1, 5))
    pd.testing.assert_frame_equal(a, b)
    assert (a.high >= a[["open", "close"]].max(axis=1)).all() and (a.low <= a[["open", "close"]].min(axis=1)).all()


def test_nulls_and_periods():
    x = cum("sum", s.gap(tickforge.plans.expr.col("close"), 0.0))
    assert math.isnan(Stepper([x]).step({"close": None})[0])
    assert tickforge.plans.expr.period_of(datetime.datetime(2024, 3, 31, tzinfo=datetime.UTC).timestamp(), "M") == 2024 * 12 + 2


def test_sql_steps_equal_kernels_with_missing_values():
    pdf = bars(90, 5, ("a", "b"))
    pdf.loc[pdf.index % 90 < 4, "close"] = np.nan
    con = duckdb.connect()
    con.register("bars", pdf)
    out = {"decay": scan("ratchet_decay", [col("close")], length=5)[0], "first": scan("adaptive", [col("close"), E("lit", (), (0.3,)), col("open")], start=6)[0], "zero": scan("adaptive", [col("open"), E("lit", (), (0.3,)), E("lit", (), (None,))], start=2, zero=0.0)[0]}
    out |= {f"bands_{i}": x for i, x in enumerate(scan("super_trend", [col("close"), col("low"), col("high")], 4, length=3))}
    got = con.sql(sql("SELECT * FROM bars", out, ["symbol"], ["ts"])).df().sort_values(["symbol", "ts"])
    for k in "ab":
        theirs = pdf[pdf.symbol == k].reset_index(drop=True)
        for name, v in zip(out, evaluate(list(out.values()), columns(theirs), {}), strict=True):
            close_to(got[got.symbol == k][name].to_numpy(dtype=float), v, 1e-5)


def test_zigzag_leaves_a_point_at_zero_as_its_sql_does():
    r = np.random.default_rng(3)
    n = 400
    low = r.choice([0.0, 0.0, -0.0, 0.25, 1.0, 3.0, -2.0], n)
    pdf = bars(n, 5).assign(low=low, high=low + r.choice([0.0, 0.01, 2.0, 7.0], n))
    pdf.loc[:20, ["low", "high"]] = [[100.0 + abs(i - 10), 101.0 + abs(i - 10)] for i in range(21)]
    pdf.loc[40:60, ["low", "high"]] = [[float(abs(i - 10)), 1.0 + abs(i - 10)] for i in range(21)]  # a single dip to zero
    con = duckdb.connect()
    con.register("bars", pdf)
    for params in ({"legs": 2}, {"legs": 4, "deviation": 50.0}, {}):
        out = REGISTRY["zigzag"].outputs(**params)
        got = con.sql(sql("SELECT * FROM bars", out, ["symbol"], ["ts"])).df().sort_values("ts")
        stepper, rows = Stepper(list(out.values())), columns(pdf)
        stepped = [stepper.step({c: float(rows[c][i]) for c in rows}) for i in range(n)]
        for j, (name, v) in enumerate(run("zigzag", pdf, **params).items()):
            assert not np.isinf(v).any()
            close_to(got[name], v, 1e-5)
            close_to([x[j] for x in stepped], v)
        swing, value = list(run("zigzag", pdf, **params).values())[:2]
        assert (value == 0).sum() > 3 and np.flatnonzero(swing == swing)[-1] > n - 60
