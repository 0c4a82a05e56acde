"""The driver's queries: every operator over hourly bars of the events table, and their SQL."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import frames, signals
from ..functions import series as s
from ..operators.registry import REGISTRY
from ..sources.bars import EVENTS_SQL, LINEITEM_SQL, events_bars, lineitem_bars
from .expr import E, col
from .sql import NotInSQL, rounded, sql
from .study import COMMON, Bars, Study
from .tables import ichimoku_forward, ifisher, tos_stdevall, vp, zigzag

DIGITS = 6
_RUNS = {"fast_": s.ema(col("close"), 8), "slow_": s.ema(col("close"), 21)}
#: Parameters of the queries where the defaults do not fit: series of their own, optional outputs.
PARAMS: dict[str, dict] = {"long_run": _RUNS, "short_run": _RUNS, "vwap": {"bands": (1, 2)}}
#: Operators whose query is of the whole series; as of each row they have one of their own.
WHOLE = ("tos_stdevall", "vp")


def _rounded(df: DataFrame, keep: list[str]) -> DataFrame:
    """Rounded like the SQL is: see sql.rounded."""

    def figure(c: str):
        x = F.col(f"`{c}`").cast("double")
        near, mid, far = F.round(x + 3.3e-8, DIGITS), F.round(x + 3e-4, DIGITS - 4), F.round(x + 3.0, DIGITS - 8)
        huge = F.format_string("%.8e", x).try_cast("double")
        return (F.when(F.abs(x) < 1e4, near).when(F.abs(x) < 1e8, mid).when(F.abs(x) < 1e15, far).when(F.abs(x) < 1e300, huge) + F.lit(0.0)).alias(c)

    return df.select(*keep, *[figure(c) for c in df.columns if c not in keep])


def _series(outputs: dict[str, E], source=events_bars) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rounded(Bars(source(spark, sf_dir)).select(outputs, ["symbol", "ts"]), ["symbol", "ts"])

    return query


def _outputs() -> dict[str, dict[str, E]]:
    out = {f"{k}_to_date" if k in WHOLE else k: op.outputs(**PARAMS.get(k, {})) for k, op in REGISTRY.items()}
    open_, high, low, close = (col(c) for c in ("open", "high", "low", "close"))
    rsi = s.rsi_like(close, 14)
    rose, fell = s.unsigned_differences(close)
    chained = [
        {"kind": "ema", "length": 10}, {"kind": "sma", "close": "EMA_10", "length": 5}, {"kind": "rsi"},
        {"kind": "bbands", "close": "RSI_14", "length": 10},
    ]
    out |= {
        "signals_above_below": {
            "CLOSE_A_OPEN": signals.above(close, open_), "CLOSE_B_OPEN": signals.below(close, open_),
            "CLOSE_A_100": signals.above(close, 100), "CLOSE_B_100": signals.below(close, 100),
        },
        "signals_cross": {
            "XA": signals.cross(close, s.sma(close, 10)), "XB": signals.cross(close, s.sma(close, 10), over=False),
            "XA_100": signals.cross(close, 100), "XB_100": signals.cross(close, 100, over=False),
        },
        "signals_levels": signals.signals("RSI_14", rsi, 70, 30),
        "signals_trend": signals.tsignals(signals.above(close, s.sma(close, 20))),
        "signals_between": signals.xsignals(rsi, 50, 50),
        "math_cube_ifisher": signals.cube(s.move(close, 1)) | {"INVFISHER": signals.ifisher(rsi, 1.0, (0, 100))},
        "math_differences": {"ROSE": rose, "FELL": fell},
        "candle_parts": {
            "COLOR": signals.candle_color(open_, close), "BODY": signals.real_body(open_, close), "RANGE": signals.high_low_range(high, low),
        },
        "ma_modes": {f"MA_{m}": s.ma(m, close, 10) for m in s.ma()},
        "study_common": COMMON.outputs(), "study_chained": Study("Chained", chained).outputs(),
        "ui_everget": REGISTRY["ui"].outputs(everget=True), "tmo_inclusive": REGISTRY["tmo"].outputs(exclusive=False, normalize=True, momentum=True),
        "rsi_signals": REGISTRY["rsi"].outputs(signal_indicators=True, xseries="open"), "macd_signals": REGISTRY["macd"].outputs(signal_indicators=True),
        "er_signals": REGISTRY["er"].outputs(signal_indicators=True, xa=0.6, xb=0.2, cross_values=True), "rsx_signals": REGISTRY["rsx"].outputs(signal_indicators=True),
        "seeds": {
            f"{k}_{name}": x for k in ("rsi", "cmo", "dm", "dema", "tema", "t3") for name, x in REGISTRY[k].outputs(seed="sma").items()
        },
    }
    for m in ("camarilla", "classic", "demark", "fibonacci", "woodie"):
        out[f"pivots_{m}"] = REGISTRY["pivots"].outputs(method=m)
    return out


def _renamed(outputs: dict[str, E]) -> dict[str, E]:
    """For SQL: times come as epoch seconds from the base query."""
    made: dict[str, E] = {}

    def moved(n: E) -> E:
        if n.key not in made:
            made[n.key] = E("col", (), ("in__ts",)) if n.op == "col" and n.p[0] == "ts" else E(n.op, tuple(moved(a) for a in n.args), n.p)
        return made[n.key]

    return {k: moved(v) for k, v in outputs.items()}


def _table(make: Callable[[DataFrame], DataFrame], keep: list[str]) -> Callable[[SparkSession, str], DataFrame]:
    """A query over the hourly bars; what is not kept as it is is rounded."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rounded(make(events_bars(spark, sf_dir)), keep)

    return query


_KEYS, _ORDER, _PRICES = ["symbol"], ["ts"], ["open", "high", "low", "close"]


def _means(bars: DataFrame) -> DataFrame:
    moved = bars.withColumn("up", F.col("close") - F.col("open"))
    return moved.groupBy("symbol").agg(
        frames.geometric_mean(F.col("close")).alias("geometric"), frames.geometric_mean(F.when(F.col("up") > 0, 0.0).otherwise(F.col("close"))).alias("with_zeros"),
        frames.log_geometric_mean(F.col("close")).alias("log_geometric"), frames.geometric_mean(F.col("up")).alias("negative"),
    )


#: name -> the table, and its columns that are no figures.
TABLES: dict[str, tuple[Callable[[DataFrame], DataFrame], list[str]]] = {
    "ta_tos_stdevall": (lambda b: tos_stdevall(b, _KEYS, _ORDER).drop(*_PRICES, "volume"), ["symbol", "ts"]),
    "ta_vp": (lambda b: vp(b, _KEYS, _ORDER), ["symbol", "bucket"]),
    "ta_vp_sorted": (lambda b: vp(b, _KEYS, _ORDER, sort=True), ["symbol", "bucket"]),
    "ta_ichimoku_forward": (lambda b: ichimoku_forward(b, _KEYS, "ts"), ["symbol", "date"]),
    "ta_zigzag_hindsight": (lambda b: zigzag(b, _KEYS, "ts").drop(*_PRICES, "volume"), ["symbol", "ts"]),
    "ta_ifisher_whole": (lambda b: ifisher(b, _KEYS, "close").select("symbol", "ts", "`INVFISHER_1.0`"), ["symbol", "ts"]),
    "frame_resample": (lambda b: frames.resample(b, _KEYS, "ts", "day"), ["symbol", "ts"]),
    "frame_baseline": (lambda b: frames.baseline(b, _KEYS, _ORDER, _PRICES, index=3, k=100.0), ["symbol", "ts"]),
    "frame_total_time": (lambda b: frames.total_time(b, _KEYS, "ts", 86400.0), ["symbol"]),
    "frame_to_date": (lambda b: frames.to_date(b, "ts", "week", F.lit("2024-01-25").cast("timestamp")), ["symbol", "ts"]),
    "frame_on_dates": (lambda b: frames.on_dates(b, "ts", ["2024-01-03", "2024-01-20"]), ["symbol", "ts"]),
    "frame_ordered": (lambda b: frames.ordered(b.withColumn("_row", F.col("ts")), _KEYS, "ts"), ["symbol", "ordered"]),
    "frame_constants": (lambda b: frames.constants(b.select("symbol", "ts"), [0.0, 70.0]), ["symbol", "ts"]),
    "math_geometric_means": (_means, ["symbol"]),
    "math_error_analysis": (lambda b: frames.error_analysis(b, b.withColumn("close", F.col("close") * 2).withColumn("open", F.col("high")), ["symbol", "ts"], ["open", "close"]), ["column"]),
}


FLAGSHIP = Study("Flagship", [
    {"kind": "sma", "length": 10}, {"kind": "ema", "length": 10}, {"kind": "rsi", "length": 14}, {"kind": "bbands", "length": 20},
])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks to hourly bars to four operators, in one plan."""
    return _rounded(Bars(events_bars(spark, sf_dir)).select(FLAGSHIP.outputs(), ["symbol", "ts"]), ["symbol", "ts"])


OUTPUTS = _outputs()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f"ta_{k}": _series(v) for k, v in OUTPUTS.items()}
QUERIES |= {k: _table(*t) for k, t in TABLES.items()} | {"flagship": flagship}
QUERIES |= {f"bars_lineitem_{k}": _series(REGISTRY[k].outputs(), lineitem_bars) for k in ("rsi", "macd")}


def _figure(x: str, name: str) -> str:
    return f'{rounded(f"CAST({x} AS DOUBLE)", DIGITS)} AS "{name}"'


def _figures(**columns: str) -> str:
    return ", ".join(_figure(x, name) for name, x in columns.items())


def _line_sql() -> str:
    bands = {f"TOS_STDEVALL_{side}_{i}": f"y {sign} {i} * d" for i in (1, 2, 3) for side, sign in (("L", "-"), ("U", "+"))}
    return f"""
    , i AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM b),
    f AS (SELECT symbol, regr_slope(close, i) AS m, regr_intercept(close, i) AS c, stddev_samp(close) AS d FROM i GROUP BY symbol),
    y AS (SELECT symbol, ts, c + m * i AS y, d FROM i JOIN f USING (symbol))
    SELECT symbol, ts, {_figures(TOS_STDEVALL_LR="y", **bands)} FROM y"""


def _profile_sql(by_price: bool) -> str:
    rows = "CASE WHEN i < (n % 10) * (n // 10 + 1) THEN i // (n // 10 + 1) ELSE n % 10 + (i - (n % 10) * (n // 10 + 1)) // (n // 10) END"
    price = "least(9, greatest(0, ceil((close - lo) * 10 / (hi - lo)) - 1))"
    side = lambda v: f"sum(CASE WHEN s = {v} THEN volume ELSE 0 END)"
    figures = _figures(
        low_close="min(close)", mean_close="avg(close)", high_close="max(close)", pos_volume=side(1), neg_volume=side(-1), neut_volume=side(0),
        total_volume="sum(CASE WHEN s <> 0 THEN volume ELSE 0 END)",
    )
    return f"""
    , q AS (SELECT *, coalesce(sign(close - lag(close) OVER (PARTITION BY symbol ORDER BY ts)), 1) AS s,
        row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n,
        min(close) OVER (PARTITION BY symbol) AS lo, max(close) OVER (PARTITION BY symbol) AS hi FROM b),
    z AS (SELECT *, CAST({price if by_price else rows} AS INTEGER) AS bucket FROM q)
    SELECT symbol, bucket, {figures} FROM z GROUP BY symbol, bucket"""


def _forward_sql() -> str:
    mid = lambda n: f"(max(high) OVER (p ROWS {n - 1} PRECEDING) + min(low) OVER (p ROWS {n - 1} PRECEDING)) / 2"
    return f"""
    , i AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM b),
    v AS (SELECT symbol, i, n, CASE WHEN i >= 26 THEN ({mid(9)} + {mid(26)}) / 2 END AS sa, CASE WHEN i >= 52 THEN {mid(52)} END AS sb
        FROM i WINDOW p AS (PARTITION BY symbol ORDER BY ts)),
    d AS (SELECT symbol, CAST(max(ts) AS DATE) + CAST(unnest(range(1, 53)) AS INTEGER) AS d FROM b GROUP BY symbol),
    f AS (SELECT symbol, d, row_number() OVER (PARTITION BY symbol ORDER BY d) AS k FROM d WHERE isodow(d) < 6)
    SELECT f.symbol, d AS date, {_figures(ISA_9="sa", ISB_26="sb")}
    FROM f LEFT JOIN v ON v.symbol = f.symbol AND v.i = greatest(n - 25, 0) + k WHERE k < 26"""


def _zigzag_sql(legs: int = 10, deviation: float = 5.0) -> str:
    """Pivots as a list of each series from the last back, and a fold over it whose points are rows of a recursion."""
    half, dev = legs // 2, deviation / 100
    tail = f"_{deviation}%_{legs}"
    around = f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING)"
    figures = _figures(**{f"ZIGZAGs{tail}": "swing", f"ZIGZAGv{tail}": "value", f"ZIGZAGd{tail}": "dev"})
    further = "(p.value - z.v) * p.swing > 0 AND z.pts > 1"
    turned = f"z.sw <> p.swing AND p.value <> 0 AND p.swing * (p.value - z.v) / p.value > {dev!r} AND p.ts <> z.ts"
    same = "z.sw = p.swing AND p.value <> 0"
    moved = f"({same} AND {further})"
    step = lambda take, keep: f"CASE WHEN {moved} OR ({turned}) THEN {take} ELSE {keep} END"
    return f"""
    , x AS (SELECT *, min(low) {around} AS lo, max(high) {around} AS hi, count(*) {around} AS n,
        row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) - 1 AS left_ FROM b),
    c AS (SELECT symbol, ts, 0 AS t, -1.0 AS swing, CAST(low AS DOUBLE) AS value FROM x WHERE n = {2 * half + 1} AND left_ > {half} AND low <= lo
        UNION ALL SELECT symbol, ts, 1, 1.0, CAST(high AS DOUBLE) FROM x WHERE n = {2 * half + 1} AND left_ > {half} AND high >= hi),
    p AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, t DESC) AS k FROM c),
    z AS (SELECT symbol, k, ts, CAST(swing AS DOUBLE) AS sw, value AS v, 1 AS pts, CAST(NULL AS DOUBLE) AS nextv FROM p WHERE k = 1
        UNION ALL SELECT p.symbol, p.k, {step("p.ts", "z.ts")}, {step("CAST(p.swing AS DOUBLE)", "z.sw")}, {step("p.value", "z.v")},
            CASE WHEN {turned} THEN z.pts + 1 ELSE z.pts END, CASE WHEN {turned} THEN z.v ELSE z.nextv END
        FROM z JOIN p ON p.symbol = z.symbol AND p.k = z.k + 1),
    ends AS (SELECT symbol, pts, max(k) AS k FROM z GROUP BY symbol, pts),
    pt AS (SELECT z.* FROM z JOIN ends USING (symbol, pts, k)),
    f AS (SELECT symbol, ts, sw AS swing, v AS value, coalesce(100 * lead_sw * (lead_v - v) / lead_v, 0.0) AS dev, pts
        FROM (SELECT *, lead(sw) OVER w AS lead_sw, lead(v) OVER w AS lead_v FROM pt WINDOW w AS (PARTITION BY symbol ORDER BY pts)))
    SELECT b.symbol, b.ts, {figures} FROM b LEFT JOIN f ON f.symbol = b.symbol AND f.ts = b.ts"""


def _tables_sql() -> dict[str, str]:
    prices = ("open", "high", "low", "close")
    base = {c: f"100.0 * {c} / nullif(nth_value({c}, 4) OVER w, 0)" for c in prices}
    plain = _figures(**{c: c for c in (*prices, "volume")})
    rows = "SELECT symbol, exp(avg(ln(close))) AS g, min(close) AS least, avg(ln(1 + close)) AS l, avg(ln(1 + CASE WHEN close > open THEN 0 ELSE close END)) AS z, min(close - open) AS m FROM b GROUP BY symbol"
    gap = lambda x, y: f"count(*) AS n, corr({x}, {y}) AS c, max(abs({x} - {y})) AS m, avg(abs({x} - {y})) AS a, avg(abs({x} - {y}) / nullif(abs({x}), 0)) AS r"
    return {
        "ta_tos_stdevall": _line_sql(), "ta_vp": _profile_sql(False), "ta_vp_sorted": _profile_sql(True), "ta_ichimoku_forward": _forward_sql(),
        "ta_zigzag_hindsight": _zigzag_sql(),
        "ta_ifisher_whole": f"""
    , e AS (SELECT symbol, min(close) AS lo, max(close) AS hi FROM b GROUP BY symbol),
    m AS (SELECT b.symbol, ts, CASE WHEN lo < -1 OR hi > 1 THEN 2 * (close - lo) / nullif(hi - lo, 0) - 1 ELSE close END AS x FROM b JOIN e USING (symbol))
    SELECT symbol, ts, {_figure("(exp(x) - 1) / (exp(x) + 1)", "INVFISHER_1.0")} FROM m""",
        "frame_resample": f"""
    SELECT symbol, date_trunc('day', ts) AS ts, {_figures(open="arg_min(open, b.ts)", high="max(high)", low="min(low)", close="arg_max(close, b.ts)", volume="sum(volume)")}
    FROM b GROUP BY symbol, date_trunc('day', ts)""",
        "frame_baseline": f"""
    SELECT symbol, ts, {_figures(**base, volume="volume")} FROM b
    WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
        "frame_total_time": f"""
    SELECT symbol, {_figures(total_time="CAST(epoch(max(ts)) - epoch(min(ts)) AS DOUBLE) / 86400")} FROM b GROUP BY symbol""",
        "frame_to_date": f" SELECT symbol, ts, {plain} FROM b WHERE ts >= TIMESTAMP '2024-01-22'",
        "frame_on_dates": f" SELECT symbol, ts, {plain} FROM b WHERE CAST(ts AS DATE) IN (DATE '2024-01-03', DATE '2024-01-20')",
        "frame_ordered": " SELECT DISTINCT symbol, true AS ordered FROM b",
        "frame_constants": f" SELECT symbol, ts, {_figure('0', '0.0')}, {_figure('70', '70.0')} FROM b",
        "math_geometric_means": f"""
    , g AS ({rows}) SELECT symbol, {_figures(geometric="CASE WHEN least > 0 THEN g ELSE 0 END", with_zeros="exp(z) - 1", log_geometric="exp(l) - 1", negative="CASE WHEN m > 0 THEN NULL ELSE 0 END")} FROM g""",
        "math_error_analysis": f"""
    , d AS (SELECT 'open' AS "column", {gap("open", "high")} FROM b UNION ALL SELECT 'close', {gap("close", "2 * close")} FROM b)
    SELECT "column", {_figures(rows="n", correlation="c", max_abs="m", mean_abs="a", mean_rel="r")} FROM d""",
    }


def oracles() -> dict[str, str]:
    out = {}
    for k, v in OUTPUTS.items():
        try:
            out[f"ta_{k}"] = sql(EVENTS_SQL, _renamed(v), ["symbol"], ["ts"], DIGITS)
        except NotInSQL:
            continue
    out["flagship"] = sql(EVENTS_SQL, FLAGSHIP.outputs(), ["symbol"], ["ts"], DIGITS)
    for k in ("rsi", "macd"):
        out[f"bars_lineitem_{k}"] = sql(LINEITEM_SQL, REGISTRY[k].outputs(), ["symbol"], ["ts"], DIGITS)
    return out | {k: f"WITH RECURSIVE b AS ({EVENTS_SQL}){q}" for k, q in _tables_sql().items()}
