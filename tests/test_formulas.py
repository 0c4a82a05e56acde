"""Operators against their definitions, written in pandas and plain loops apart from the expression graphs."""

import math

import numpy as np
import pandas as pd
import pytest
import tickforge.operators  # noqa: F401
from tickforge.operators.registry import REGISTRY
from tickforge.plans.vector import evaluate

N = 700


def made(n=N, seed=17):
    r = np.random.default_rng(seed)
    c = 100 + r.normal(size=n).cumsum() * 0.6
    o = c + r.normal(size=n) * 0.4
    v = r.integers(100, 1000, n).astype(float)
    ts = pd.date_range("2025-01-01", periods=n, freq="h")
    return pd.DataFrame({"ts": ts, "open": o, "high": np.maximum(o, c) + r.random(n), "low": np.minimum(o, c) - r.random(n), "close": c, "volume": v})


D = made()
O, H, L, C, V = (D[c] for c in ("open", "high", "low", "close", "volume"))
HL2, TP, HL = (H + L) / 2, (H + L + C) / 3, H - L
PC = C.shift()
TR = pd.concat([HL, (H - PC).abs(), (PC - L).abs()], axis=1).max(axis=1)
NAN = float("nan")


def series(x):
    return pd.Series(np.asarray(x, dtype=float))


def sma(x, n):
    return x.rolling(n).mean()


def ema(x, n):
    """Seeded with the mean of the first n rows."""
    x = x.copy()
    x.iloc[n - 1] = x.iloc[:n].mean()
    x.iloc[: n - 1] = NAN
    return x.ewm(span=n, adjust=False).mean()


def ema_from(x, n, first):
    """An EMA of the rows from `first` on."""
    return ema(x.iloc[first:].reset_index(drop=True), n).reindex(range(-first, N - first)).reset_index(drop=True)


def rma(x, n):
    return x.ewm(alpha=1 / n, adjust=False).mean()


def smma(x, n):
    out = [NAN] * (n - 1) + [x.iloc[:n].mean()]
    for v in x.iloc[n:]:
        out.append(((n - 1) * out[-1] + v) / n)
    return series(out)


def weighted(x, w):
    w = np.asarray(w, dtype=float) / np.sum(w)
    return x.rolling(len(w)).apply(lambda y: np.dot(y, w), raw=True)


def wma(x, n):
    return weighted(x, np.arange(1, n + 1))


def atr(n, kind=rma):
    t = TR.copy()
    t.iloc[n - 1] = t.iloc[:n].mean()
    t.iloc[: n - 1] = NAN
    return kind(t, n)


def seen(x, n):
    """An unseeded EMA, from the first value there is."""
    return x.ewm(span=n, adjust=False).mean()


def sums(x, n):
    return x.rolling(n).sum()


def up(x):
    return x.clip(lower=0)


def rsi(x, n):
    d = x.diff()
    p, q = rma(up(d), n), rma(up(-d), n)
    return 100 * p / (p + q)


def roc(x, n):
    return 100 * (x / x.shift(n) - 1)


def stoch(n, x=None):
    lo, hi = (L.rolling(n).min(), H.rolling(n).max()) if x is None else (x.rolling(n).min(), x.rolling(n).max())
    return 100 * ((C if x is None else x) - lo) / (hi - lo)


def clv():
    return (2 * C - H - L) / HL


def obv():
    return (np.sign(C.diff()).fillna(1) * V).cumsum()


def chain(x, n, levels):
    out = [ema(x, n)]
    for _ in range(levels - 1):
        out.append(seen(out[-1], n))
    return out


def heikin():
    hc, ho = (O + H + L + C) / 4, [(O[0] + C[0]) / 2]
    for i in range(1, N):
        ho.append((ho[-1] + hc[i - 1]) / 2)
    return series(ho), hc


def fisher(n=9):
    lo, hi = HL2.rolling(n).min(), HL2.rolling(n).max()
    pos, v, out = (HL2 - lo) / (hi - lo).clip(lower=0.001) - 0.5, 0.0, [NAN] * (n - 1) + [0.0]
    for i in range(n, N):
        v = 0.66 * pos[i] + 0.67 * v
        v = -0.999 if v < -0.99 else 0.999 if v > 0.99 else v
        out.append(0.5 * (math.log((1 + v) / (1 - v)) + out[-1]))
    return series(out)


def kama(n=10, fast=2, slow=30):
    er = (C - C.shift(n)).abs() / sums(C.diff().abs(), n)
    sc = (er * (2 / (fast + 1) - 2 / (slow + 1)) + 2 / (slow + 1)) ** 2
    out = [NAN] * (n - 1) + [C[:n].mean()]
    for i in range(n, N):
        out.append(sc[i] * C[i] + (1 - sc[i]) * out[-1])
    return series(out)


def vidya(n=14):
    d = C.diff()
    p, q = sums(up(d), n), sums(up(-d), n)
    k, y, out = ((p - q) / (p + q)).abs() * 2 / (n + 1), 0.0, [NAN] * n
    for i in range(n, N):
        y = k[i] * C[i] + (1 - k[i]) * y
        out.append(y)
    return series(out)


def hwma(na=0.2, nb=0.1, nc=0.1):
    f, v, a, out = C[0], 0.0, 0.0, []
    for x in C:
        f1 = (1 - na) * (f + v + 0.5 * a) + na * x
        v1 = (1 - nb) * (v + a) + nb * (f1 - f)
        a = (1 - nc) * a + nc * (v1 - v)
        f, v = f1, v1
        out.append(f + v + 0.5 * a)
    return series(out)


def mcginley(n=10):
    m, out = C[0], [NAN]
    for x in C[1:]:
        m += (x - m) / (n * (x / m) ** 4)
        out.append(m)
    return series(out)


def super_smoother(x, n, cosine):
    a = math.exp(-3.14159 * 1.414 / n)
    b, out = 2 * a * cosine, x.iloc[:2].tolist()
    c = a * a - b + 1
    for i in range(2, N):
        out.append(0.5 * c * (x[i] + x[i - 1]) + b * out[-1] - a * a * out[-2])
    return series(out)


def ssf3(n=20):
    a = math.exp(-3.14159 / n)
    b, c = 2 * a * math.cos(3.14159 * 1.732 / n), a * a
    d4, d3, d2, out = c * c, -(c * (1 + b)), b + c, C[:3].tolist()
    d1 = 1 - d2 - d3 - d4
    for i in range(3, N):
        out.append(d1 * C[i] + d2 * out[-1] + d3 * out[-2] + d4 * out[-3])
    return series(out)


def flex(slope, n=20, alpha=0.04):
    f, ms, out = smoothed_from_zero(n), 0.0, [NAN] * n
    for i in range(n, N):
        m = (f[i - n] - f[i]) / n if slope else 0.0
        total = sum(f[i] + j * m - f[i - j] for j in range(1, n if slope else n + 1)) / n
        ms = alpha * total * total + (1 - alpha) * ms
        out.append(total / math.sqrt(ms) if ms else 0.0)
    return series(out)


def smoothed_from_zero(n):
    """The super-smoother whose first two values are zero."""
    a = math.exp(-3.14159 * 2 * 1.414 / n)
    b, out = 2 * a * math.cos(180 * 2 * 1.414 / n), [0.0, 0.0]
    for i in range(2, N):
        out.append(0.5 * (a * a - b + 1) * (C[i] + C[i - 1]) + b * out[-1] - a * a * out[-2])
    return out


def hilo():
    top, low, y, out = sma(H, 13), sma(L, 21), NAN, []
    for i in range(N):
        if i and C[i] > top[i - 1]:
            y = low[i]
        elif i and C[i] < low[i - 1]:
            y = top[i]
        out.append(y)
    return series(out)


def exhaustion(sign):
    run, out = 0, []
    for d in C.diff(4):
        run = run + 1 if sign * d > 0 else 0
        out.append(min(run, 13))
    return series(out)


def ranked(x, n):
    """The share of the n values before that are less; the missing first one is not."""
    x = x.to_numpy()
    return series([NAN] * n + [100 * np.sum(x[i - n : i] < x[i]) / n for i in range(n, N)])


def directional(sign):
    a, b = H.diff(), -L.diff()
    x = a.where((a > b) & (a > 0), 0.0) if sign > 0 else b.where((b > a) & (b > 0), 0.0)
    x.iloc[0] = NAN
    return x


def dx(n=14):
    k = 100 / atr(n)
    p, q = k * rma(directional(1).fillna(0), n), k * rma(directional(-1).fillna(0), n)
    return p, q, 100 * (p - q).abs() / (p + q)


def thermo():
    return pd.concat([(L.shift() - L).abs(), (H - H.shift()).abs()], axis=1).max(axis=1)


def vwap(anchor):
    g = D["ts"].dt.to_period(anchor)
    return (TP * V).groupby(g).cumsum() / V.groupby(g).cumsum()


def bars_of(n):
    return C.rolling(n).mean(), C.rolling(n).std()


def line(x, n, at):
    return x.rolling(n).apply(lambda w: np.polyval(np.polyfit(np.arange(1, n + 1), w, 1), at), raw=True)


def tmo(opens=14):
    total = sum(np.sign(C - O.shift(j)) for j in range(1, opens + 1))
    total.iloc[:opens] = NAN
    return total


def tsi(x, slow, fast):
    double = lambda y: seen(ema(y, slow), fast)
    return 100 * double(x.diff()) / double(x.diff().abs())


def uo():
    low = np.minimum(L, PC)
    bp, tr = C - low, np.maximum(H, PC) - low
    avg = lambda n: sums(bp, n) / sums(tr, n)
    return 100 * (4 * avg(7) + 2 * avg(14) + avg(28)) / 7


def pivot_points():
    g = D["ts"].dt.date
    d = D.groupby(g).agg(o=("open", "first"), h=("high", "max"), low=("low", "min"), c=("close", "last")).shift(1)
    return d.reindex(g).reset_index(drop=True)


def keltner(k):
    return sma(C, 20) - k * sma(TR, 20), sma(C, 20) + k * sma(TR, 20)


def inside(k):
    (lo, hi), (mid, dev) = keltner(k), bars_of(20)
    return (mid - 2 * dev > lo) & (mid + 2 * dev < hi)


def outside(k):
    (lo, hi), (mid, dev) = keltner(k), bars_of(20)
    return (mid - 2 * dev < lo) & (mid + 2 * dev > hi)


def chandelier():
    long, short, side, out = H.rolling(22, min_periods=1).max() - 2 * atr(14), L.rolling(22, min_periods=1).min() + 2 * atr(14), 1.0, []
    for i in range(N):
        up_, down = i and C[i] > long[i - 1], i and C[i] < short[i - 1]
        side = 1.0 if up_ and not down else -1.0 if down and not up_ else side
        out.append(side)
    return long, short, series(out)


def volatility_index(x, n):
    dev, d = x.rolling(n).std(), x.diff()
    p, q = seen((d > 0) * dev, n), seen((d < 0) * dev, n)
    return 100 * p / (p + q)


def decayed(n):
    out = [C[0]]
    for x in C[1:]:
        out.append(max(0, x, out[-1] - 1 / n))
    return series(out)


def qqe():
    r = ema(rsi(C, 14), 5)
    width = 4.236 * ema(ema(r.diff().abs(), 27), 27)
    low, high, long, short, trend = r - width, r + width, [0.0], [0.0], 1
    y, ls, ss = [r[0]], [NAN], [NAN]
    for i in range(1, N):
        l1, s1 = long[-1], short[-1]
        l2, s2 = (long[-2], short[-2]) if i > 1 else (0.0, 0.0)
        long.append(np.maximum(l1, low[i]) if r[i - 1] > l1 and r[i] > l1 else low[i])
        short.append(np.minimum(s1, high[i]) if r[i - 1] < s1 and r[i] < s1 else high[i])
        if (r[i] > s1 and r[i - 1] < s2) or (r[i] <= s1 and r[i - 1] >= s2):
            trend = 1
        elif (r[i] > l1 and r[i - 1] < l2) or (r[i] <= l1 and r[i - 1] >= l2):
            trend = -1
        y.append(long[-1] if trend == 1 else short[-1])
        ls.append(long[-1] if trend == 1 else NAN)
        ss.append(NAN if trend == 1 else short[-1])
    return series(y), series(ls), series(ss)


def alphatrend():
    width, strong, y, out = atr(14, sma), rsi(C, 14) >= 50, 0.0, [NAN]
    low, high = L - width, H + width
    for i in range(1, N):
        if strong[i]:
            y = y if low[i] < y else low[i]
        else:
            y = y if high[i] > y else high[i]
        out.append(y)
    return series(out)


def trailing():
    width, mean, y, out = 3 * atr(14, seen), ema(C, 20), NAN, []
    for i in range(N):
        if i >= 20:
            up_ = C[i] > mean[i]
            new = C[i] - width[i] if up_ else C[i] + width[i]
            y = y if (up_ and new < y) or (not up_ and new > y) else new
        out.append(y)
    return series(out)


P = pivot_points()
DX = dx()
E5 = chain(C, 10, 6)

FORMULAS = {
    "ao": {"AO_5_34": lambda: sma(HL2, 5) - sma(HL2, 34)},
    "apo": {"APO_12_26": lambda: sma(C, 12) - sma(C, 26)},
    "bias": {"BIAS_SMA_26": lambda: C / sma(C, 26) - 1},
    "bop": {"BOP": lambda: (C - O) / HL},
    "brar": {"AR_26": lambda: 100 * sums(H - O, 26) / sums(O - L, 26), "BR_26": lambda: 100 * sums(up(H - PC).where(PC.notna()), 26) / sums(up(PC - L).where(PC.notna()), 26)},
    "cg": {"CG_10": lambda: C.rolling(10).apply(lambda w: -np.dot(w, np.arange(1, 11)) / w.sum(), raw=True)},
    "cfo": {"CFO_9": lambda: 100 * (C - line(C, 9, 10)) / C},
    "cmo": {"CMO_14": lambda: 100 * (rma(up(C.diff()), 14) - rma(up(-C.diff()), 14)) / (rma(up(C.diff()), 14) + rma(up(-C.diff()), 14))},
    "coppock": {"COPC_11_14_10": lambda: wma(roc(C, 11) + roc(C, 14), 10)},
    "crsi": {"CRSI_3_2_100": lambda: (rsi(C, 3) + rsi(np.sign(C.diff()).fillna(0), 2) + ranked(C.pct_change(), 100)) / 3},
    "eri": {"BULLP_13": lambda: H - ema(C, 13), "BEARP_13": lambda: L - ema(C, 13)},
    "exhc": {"EXHC_DNa": lambda: exhaustion(-1), "EXHC_UPa": lambda: exhaustion(1)},
    "fisher": {"FISHERT_9_1": fisher, "FISHERTs_9_1": lambda: fisher().shift()},
    "kst": {
        "KST_10_15_20_30_10_10_10_15": lambda: 100 * (sma(roc(C, 10), 10) + 2 * sma(roc(C, 15), 10) + 3 * sma(roc(C, 20), 10) + 4 * sma(roc(C, 30), 15)),
        "KSTs_9": lambda: sma(100 * (sma(roc(C, 10), 10) + 2 * sma(roc(C, 15), 10) + 3 * sma(roc(C, 20), 10) + 4 * sma(roc(C, 30), 15)), 9),
    },
    "kdj": {"D_9_3": lambda: stoch(9).ewm(alpha=1 / 3, min_periods=3).mean().ewm(alpha=1 / 3, min_periods=3).mean()},
    "mom": {"MOM_10": lambda: C - C.shift(10)},
    "pgo": {"PGO_14": lambda: (C - sma(C, 14)) / seen(atr(14), 14)},
    "ppo": {"PPO_12_26_9": lambda: 100 * (sma(C, 12) - sma(C, 26)) / sma(C, 26)},
    "psl": {"PSL_12": lambda: 100 * sums((C.diff() > 0).astype(float), 12) / 12},
    "qstick": {"QS_10": lambda: sma(C - O, 10)},
    "roc": {"ROC_10": lambda: roc(C, 10)},
    "rvgi": {"RVGI_14_4": lambda: sums(weighted(C - O, [1, 2, 2, 1]), 14) / (sums(weighted(HL, [1, 2, 2, 1]), 14) + 1e-10)},
    "slope": {"SLOPE_1": lambda: C.diff()},
    "smi": {"SMI_5_20_5_1": lambda: tsi(C, 20, 5) / 100},
    "stoch": {"STOCHk_14_3_3": lambda: sma(stoch(14), 3), "STOCHh_14_3_3": lambda: sma(stoch(14), 3) - sma(sma(stoch(14), 3), 3)},
    "stochf": {"STOCHFk_14_3": lambda: stoch(14), "STOCHFd_14_3": lambda: sma(stoch(14), 3)},
    "stochrsi": {"STOCHRSIk_14_14_3_3": lambda: sma(stoch(14, rsi(C, 14)), 3), "STOCHRSId_14_14_3_3": lambda: sma(sma(stoch(14, rsi(C, 14)), 3), 3)},
    "tmo": {"TMO_14_5_3": lambda: seen(seen(tmo(), 5), 3)},
    "tsi": {"TSI_13_25_13": lambda: tsi(C, 25, 13)},
    "uo": {"UO_7_14_28": uo},
    "alligator": {"AGj_13_8_5": lambda: smma(C, 13), "AGt_13_8_5": lambda: smma(C, 8), "AGl_13_8_5": lambda: smma(C, 5)},
    "fwma": {"FWMA_10": lambda: weighted(C, [1, 1, 2, 3, 5, 8, 13, 21, 34, 55])},
    "hilo": {"HILO_13_21": hilo},
    "hl2": {"HL2": lambda: HL2}, "hlc3": {"HLC3": lambda: TP}, "ohlc4": {"OHLC4": lambda: (O + H + L + C) / 4},
    "hwma": {"HWMA_0.2_0.1_0.1": hwma},
    "ichimoku": {
        "ITS_9": lambda: (H.rolling(9).max() + L.rolling(9).min()) / 2, "IKS_26": lambda: (H.rolling(26).max() + L.rolling(26).min()) / 2,
        "ISB_26": lambda: ((H.rolling(52).max() + L.rolling(52).min()) / 2).shift(25),
        "ISA_9": lambda: ((H.rolling(9).max() + L.rolling(9).min() + H.rolling(26).max() + L.rolling(26).min()) / 4).shift(25),
    },
    "kama": {"KAMA_10_2_30": kama},
    "mcgd": {"MCGD_10": mcginley},
    "midpoint": {"MIDPOINT_2": lambda: (C.rolling(2).max() + C.rolling(2).min()) / 2},
    "midprice": {"MIDPRICE_2": lambda: (H.rolling(2).max() + L.rolling(2).min()) / 2},
    "pivots": {
        "PIVOTS_TRAD_D_P": lambda: (P.h + P.low + P.c) / 3, "PIVOTS_TRAD_D_R1": lambda: 2 * (P.h + P.low + P.c) / 3 - P.low,
        "PIVOTS_TRAD_D_S2": lambda: (P.h + P.low + P.c) / 3 - (P.h - P.low), "PIVOTS_TRAD_D_R2": lambda: (P.h + P.low + P.c) / 3 + (P.h - P.low),
    },
    "pwma": {"PWMA_10": lambda: weighted(C, [math.comb(9, k) for k in range(10)])},
    "sinwma": {"SINWMA_14": lambda: weighted(C, [math.sin((i + 1) * math.pi / 15) for i in range(14)])},
    "ssf": {"SSF_20": lambda: super_smoother(C, 20, math.cos(180 * 1.414 / 20))},
    "ssf3": {"SSF3_20": ssf3},
    "reflex": {"REFLEX_20_20_0.04": lambda: flex(True)}, "trendflex": {"TRENDFLEX_20_20_0.04": lambda: flex(False)},
    "swma": {"SWMA_10": lambda: weighted(C, [1, 2, 3, 4, 5, 5, 4, 3, 2, 1])},
    "t3": {"T3_10_0.7": lambda: -(0.7**3) * E5[5] + (3 * 0.49 + 3 * 0.343) * E5[4] + (-6 * 0.49 - 2.1 - 3 * 0.343) * E5[3] + (1 + 2.1 + 0.343 + 3 * 0.49) * E5[2]},
    "tema": {"TEMA_10": lambda: 3 * (E5[0] - E5[1]) + E5[2]},
    "trima": {"TRIMA_10": lambda: sma(sma(C, 6), 6)},
    "vidya": {"VIDYA_14": vidya},
    "wcp": {"WCP": lambda: (H + L + 2 * C) / 4},
    "zlma": {"ZL_EMA_10": lambda: ema(2 * C - C.shift(4), 10)},
    "drawdown": {"DD_PCT": lambda: 1 - C / C.cummax(), "DD_LOG": lambda: np.log(C.cummax()) - np.log(C)},
    "log_return": {"LOGRET_1": lambda: np.log(C / PC)}, "percent_return": {"PCTRET_1": lambda: C / PC - 1},
    "entropy": {"ENTP_10": lambda: sums(-(C / sums(C, 10)) * np.log2(C / sums(C, 10)), 10)},
    "mad": {"MAD_30": lambda: C.rolling(30).apply(lambda w: np.abs(w - w.mean()).mean(), raw=True)},
    "quantile": {"QTL_30_0.5": lambda: C.rolling(30).quantile(0.5)},
    "stdev": {"STDEV_30": lambda: C.rolling(30).std()}, "variance": {"VAR_30": lambda: C.rolling(30).var()},
    "adx": {"DMP_14": lambda: DX[0], "DMN_14": lambda: DX[1], "ADX_14": lambda: rma(DX[2], 14), "ADXR_14_2": lambda: (rma(DX[2], 14) + rma(DX[2], 14).shift(2)) / 2},
    "dm": {"DMP_14": lambda: rma(directional(1).fillna(0), 14), "DMN_14": lambda: rma(directional(-1).fillna(0), 14)},
    "amat": {},
    "chop": {"CHOP_14_1_100": lambda: 100 * (np.log10(sums(TR, 14)) - np.log10(H.rolling(14).max() - L.rolling(14).min())) / math.log10(14)},
    "cksp": {"CKSPl_10_3_20": lambda: (H.rolling(10).max() - 3 * atr(10)).rolling(20).max(), "CKSPs_10_3_20": lambda: (L.rolling(10).min() + 3 * atr(10)).rolling(20).min()},
    "decreasing": {"DEC_1": lambda: (C.diff() < 0).astype(float)}, "increasing": {"INC_1": lambda: (C.diff() > 0).astype(float)},
    "dpo": {"DPO_20": lambda: C - sma(C, 20).shift(11)},
    "rwi": {"RWIh_14": lambda: (H - L.shift(14)) / (atr(14) * math.sqrt(14)), "RWIl_14": lambda: (H.shift(14) - L) / (atr(14) * math.sqrt(14))},
    "vortex": {"VTXP_14": lambda: sums((H - L.shift()).abs(), 14) / sums(TR, 14), "VTXM_14": lambda: sums((L - H.shift()).abs(), 14) / sums(TR, 14)},
    "aberration": {"ABER_ZG_5_15": lambda: sma(TP, 5), "ABER_SG_5_15": lambda: sma(TP, 5) + atr(15), "ABER_XG_5_15": lambda: sma(TP, 5) - atr(15)},
    "accbands": {"ACCBL_20": lambda: sma(L * (1 - 4 * HL / (H + L)), 20), "ACCBM_20": lambda: sma(C, 20), "ACCBU_20": lambda: sma(H * (1 + 4 * HL / (H + L)), 20)},
    "bbands": {"BBB_5_2.0_2.0": lambda: 400 * bars_of(5)[1] / bars_of(5)[0], "BBP_5_2.0_2.0": lambda: (C - bars_of(5)[0] + 2 * bars_of(5)[1]) / (4 * bars_of(5)[1])},
    "donchian": {"DCL_20_20": lambda: L.rolling(20).min(), "DCU_20_20": lambda: H.rolling(20).max(), "DCM_20_20": lambda: (L.rolling(20).min() + H.rolling(20).max()) / 2},
    "kc": {"KCLe_20_2": lambda: ema(C, 20) - 2 * ema(TR, 20), "KCUe_20_2": lambda: ema(C, 20) + 2 * ema(TR, 20)},
    "massi": {"MASSI_9_25": lambda: sums(ema(HL, 9) / seen(ema(HL, 9), 9), 25)},
    "natr": {"NATR_14": lambda: 100 / C * atr(14, seen)},
    "pdist": {"PDIST": lambda: 2 * HL + (O - PC).abs() - (C - O).abs()},
    "thermo": {"THERMO_20_2_0.5": thermo},
    "true_range": {"TRUERANGE_1": lambda: TR},
    "ui": {"UI_14": lambda: np.sqrt(sums((100 * (C / C.rolling(14).max() - 1)) ** 2, 14) / 14)},
    "ad": {"AD": lambda: (clv() * V).cumsum()}, "adosc": {"ADOSC_3_10": lambda: ema((clv() * V).cumsum(), 3) - ema((clv() * V).cumsum(), 10)},
    "aobv": {"OBVe_4": lambda: ema(obv(), 4), "OBV_min_2": lambda: obv().rolling(2).min(), "OBV_max_2": lambda: obv().rolling(2).max()},
    "cmf": {"CMF_20": lambda: sums(clv() * V, 20) / sums(V, 20)},
    "efi": {"EFI_13": lambda: ema_from(C.diff() * V, 13, 0)},
    "eom": {"EOM_14_100000000": lambda: sma(HL2.diff() / ((V / 1e8) / HL), 14)},
    "kvo": {"KVO_34_55_13": lambda: ema(V * np.sign(TP.diff()).fillna(-1), 34) - ema(V * np.sign(TP.diff()).fillna(-1), 55)},
    "nvi": {"NVI_1": lambda: 1000 + (100 * C.pct_change()).where(V.diff() < 0, 0.0).cumsum()},
    "pvo": {"PVO_12_26_9": lambda: 100 * (ema(V, 12) - ema(V, 26)) / ema(V, 26)},
    "pvol": {"PVOL": lambda: C * V},
    "pvt": {"PVT": lambda: (100 * C.pct_change() * V).cumsum()},
    "vwap": {"VWAP_D": lambda: vwap("D")},
    "ha": {"HA_open": lambda: heikin()[0], "HA_close": lambda: heikin()[1], "HA_high": lambda: pd.concat([H, *heikin()], axis=1).max(axis=1)},
    "cdl_inside": {"CDL_INSIDE": lambda: 100.0 * ((H < H.shift()) & (L > L.shift()))},
    "cdl_z": {"open_Z_30_1": lambda: (O - sma(O, 30)) / O.rolling(30).std(), "low_Z_30_1": lambda: (L - sma(L, 30)) / L.rolling(30).std()},
    "hwc": {"HWM_1": hwma},
    "ttm_trend": {"TTM_TRND_6": lambda: pd.Series(np.where(C > sma(HL2, 6), 1.0, -1.0)).where(sma(HL2, 6).notna())},
    "pvr": {"PVR": lambda: np.where(C.diff().fillna(0) >= 0, np.where(V.diff().fillna(0) >= 0, 1.0, 2.0), np.where(V.diff().fillna(0) >= 0, 3.0, 4.0))},
    "cdl_doji": {"CDL_DOJI_10_0.1": lambda: 100.0 * ((C - O).abs() < 0.1 * sma(HL, 10))},
    "squeeze": {
        "SQZ_20_2.0_20_1.5": lambda: sma(C - C.shift(12), 6), "SQZ_ON": lambda: inside(1.5).astype(float), "SQZ_OFF": lambda: outside(1.5).astype(float),
        "SQZ_NO": lambda: (~inside(1.5) & ~outside(1.5)).astype(float),
    },
    "squeeze_pro": {"SQZPRO_ON_WIDE": lambda: inside(2).astype(float), "SQZPRO_ON_NARROW": lambda: inside(1).astype(float), "SQZPRO_OFF": lambda: outside(2).astype(float)},
    "chandelier_exit": {"CHDLREXTl_22_22_14_2.0": lambda: chandelier()[0], "CHDLREXTs_22_22_14_2.0": lambda: chandelier()[1], "CHDLREXTd_22_22_14_2.0": lambda: chandelier()[2]},
    "rvi": {"RVI_14": lambda: volatility_index(C, 14)}, "inertia": {"INERTIA_20_14": lambda: line(volatility_index(C, 14), 20, 20)},
    "smc": {
        "SMCbi_14_50_20_5": lambda: L - H.shift(2), "SMCtp_14_50_20_5": lambda: 100 * (L.shift(2) - H) / (H.rolling(14).max() - L.rolling(14).min()),
        "SMChv_14_50_20_5": lambda: (HL > 1.5 * sma(HL, 20)).astype(float),
        "SMCbf_14_50_20_5": lambda: ((L > H.shift(2)) & (100 * (L - H.shift(2)) / (H.rolling(14).max() - L.rolling(14).min()) > 1)).astype(float),
    },
    "tsv": {"TSV_18_10": lambda: sums(V * C.diff(), 18), "TSVs_18_10": lambda: sma(sums(V * C.diff(), 18), 10), "TSVr_18_10": lambda: sums(V * C.diff(), 18) / sma(sums(V * C.diff(), 18), 10)},
    "decay": {"LDECAY_1": lambda: decayed(1)}, "qqe": {"QQE_14_5_4.236": lambda: qqe()[0], "QQEl_14_5_4.236": lambda: qqe()[1], "QQEs_14_5_4.236": lambda: qqe()[2]},
    "alphatrend": {"ALPHAT_14_1_50": lambda: alphatrend(), "ALPHATl_14_1_50_2": lambda: alphatrend().shift(2)},
    "atrts": {"ATRTSe_14_20_3.0": lambda: trailing()},
    "vhm": {"VHM_610": lambda: (V - sma(V, 610)) / V.rolling(610).std(ddof=0)},
    "tos_stdevall": {"TOS_STDEVALL_LR": lambda: series([NAN, *[np.polyval(np.polyfit(np.arange(i), C[:i], 1), i - 1) for i in range(2, N + 1)]]), "TOS_STDEVALL_U_2": lambda: series([NAN, *[np.polyval(np.polyfit(np.arange(i), C[:i], 1), i - 1) + 2 * C[:i].std() for i in range(2, N + 1)]])},
}


def run(kind, **params):
    out = REGISTRY[kind].outputs(**params)
    columns = {c: D[c].to_numpy(dtype=float) for c in ("open", "high", "low", "close", "volume")} | {"ts": D["ts"].astype("int64").to_numpy() / 1e9}
    return dict(zip(out, evaluate(list(out.values()), columns, {}), strict=True))


@pytest.mark.parametrize(("kind", "name"), [(k, n) for k, f in FORMULAS.items() for n in f])
def test_definition(kind, name):
    got, want = np.asarray(run(kind)[name], dtype=float), np.asarray(FORMULAS[kind][name](), dtype=float)
    assert len(got) == len(want)
    off = np.isnan(got) != np.isnan(want)
    assert not off.any(), (np.flatnonzero(off)[:6], got[:40], want[:40])
    assert np.allclose(got, want, rtol=1e-7, atol=1e-7, equal_nan=True), (np.flatnonzero(~np.isclose(got, want, rtol=1e-7, atol=1e-7, equal_nan=True))[:6], got[:40], want[:40])
