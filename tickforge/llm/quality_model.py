"""Quality scores: random Fourier features of document statistics, ridge regression from partition-summed normal
equations, and isotonic calibration."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, id_remainder, materialize

N_FEATURES = 160
RIDGE = 1e-3
GAMMA = 0.08
#: Score bins of the isotonic fit.
BINS = 2048
THRESHOLD = 0.3
STATS = 16


def statistics(text: str | None) -> list[float]:
    """Figures of a whole text: sizes, word lengths, shares of character classes, repetition, line shape."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * STATS
    by = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    chars = max(1, len(raw) - int(by[[32, 9, 10, 11, 12, 13]].sum()))
    upper, lower = int(by[65:91].sum()), int(by[97:123].sum())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    ended = sum(x.rstrip()[-1:] in (b".", b"?", b"!", b'"') for x in lines)
    share = lambda s: float(by[list(s)].sum()) / chars
    return [
        np.log1p(n), float(lengths.mean()), float(lengths.std()), upper / max(1, upper + lower), share(b"#*$%&|<>"), share(b"!?"), share(b"0123456789"), share(b".,;:"),
        len(set(words)) / n, len(set(zip(words, words[1:], words[2:], strict=False))) / max(1, n - 2), len(set(lines)) / len(lines), ended / len(lines), np.log1p(n / len(lines)), by[124] / n,
        float(by[128:].sum()) / chars, np.log1p(len(lines)),
    ]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _statistics(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([np.asarray(statistics(t), dtype=float) for t in texts.tolist()], dtype=object)


class Fourier:
    """cos(xW + b): inner products approximate a Gaussian kernel of the standardised statistics."""

    def __init__(self, mean: np.ndarray, std: np.ndarray, features: int = N_FEATURES, gamma: float = GAMMA, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.std = mean, np.where(std > 1e-9, std, 1.0)
        self.w = rng.normal(0.0, np.sqrt(2 * gamma), (len(mean), features))
        self.b = rng.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.std, -8, 8)
        return np.hstack([np.sqrt(2.0 / len(self.b)) * np.cos(z @ self.w + self.b), np.ones((len(x), 1))])


def _normal_sums(fourier: Fourier):
    """A partition's part of the normal equations: features by features, features by label, and the number of rows."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        d = len(fourier.b) + 1
        total = np.zeros((d, d + 2))
        for rows in batches:
            if len(rows):
                phi = fourier(np.stack(rows["stats"].to_numpy()))
                total[:, :d] += phi.T @ phi
                total[:, d] += phi.T @ rows["label"].to_numpy()
                total[0, d + 1] += len(rows)
        yield pd.DataFrame({"sums": [total.ravel()]})

    return sums


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators over points sorted by x: (centre, value) of each pool, values rising."""
    pools: list[list[float]] = []  # weight, weighted x, weighted y
    for a, b, w in zip(x.tolist(), y.tolist(), weight.tolist(), strict=True):
        pools.append([w, w * a, w * b])
        while len(pools) > 1 and pools[-2][2] / pools[-2][0] >= pools[-1][2] / pools[-1][0]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    return np.array([p[1] / p[0] for p in pools]), np.array([p[2] / p[0] for p in pools])


class Model:
    def __init__(self, fourier: Fourier, weights: np.ndarray, centres: np.ndarray, values: np.ndarray) -> None:
        self.fourier, self.weights, self.centres, self.values = fourier, weights, centres, values

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.fourier(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """The calibrated score; a thousandth of it follows the raw score, so that pools keep their inner order."""
        s = self.raw(x)
        level = np.interp(s, self.centres, self.values) if len(self.centres) else np.full(len(s), 0.5)
        return np.clip(0.999 * level + 0.001 / (1 + np.exp(-np.clip(s, -30, 30))), 0.0, 1.0)


def train(rows: DataFrame) -> Model | None:
    """rows: stats, label (0 or 1), fit (boolean: fitted on, else calibrated on). All rows count. The normal equations
    are summed in each partition and added up number by number, so the driver gets one system of fixed size; the
    calibration sees counts of score bins. None if there are no rows."""
    rows = rows.select("stats", F.col("label").cast("double").alias("label"), "fit")
    fit = rows.filter("fit")
    parts = [f(F.element_at("stats", i + 1)) for f in (F.avg, F.stddev_pop) for i in range(STATS)]
    figures = fit.agg(F.count("*").alias("n"), *[p.alias(f"p{i}") for i, p in enumerate(parts)]).first()
    if not figures.n:
        fit, figures = rows, rows.agg(F.count("*").alias("n"), *[p.alias(f"p{i}") for i, p in enumerate(parts)]).first()
        if not figures.n:
            return None
    fourier = Fourier(np.array(figures[1 : STATS + 1]), np.array(figures[STATS + 1 :]))
    d = N_FEATURES + 1
    parts = fit.select("stats", "label").mapInPandas(_normal_sums(fourier), "sums array<double>")
    sums = parts.select(F.posexplode("sums").alias("at", "part")).groupBy("at").agg(F.sum("part").alias("total")).toPandas()
    total = sums.sort_values("at")["total"].to_numpy().reshape(d, d + 2)
    ridge = RIDGE * total[0, d + 1] * np.eye(d)
    ridge[-1, -1] = 1e-9
    model = Model(fourier, np.linalg.solve(total[:, :d] + ridge, total[:, d]), np.zeros(0), np.zeros(0))

    @F.pandas_udf("double")
    def raw(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series(model.raw(np.stack(x.to_numpy())) if len(x) else np.zeros(0))

    scored = rows.filter("not fit").select(raw("stats").alias("s"), "label")
    bins = scored.groupBy(F.floor(F.greatest(F.lit(-0.5), F.least(F.lit(1.5), "s")) * (BINS / 2)).alias("bin")).agg(F.avg("s").alias("x"), F.avg("label").alias("y"), F.count("*").alias("n")).orderBy("x").toPandas()
    if len(bins):
        model.centres, model.values = isotonic(bins["x"].to_numpy(), bins["y"].to_numpy(), bins["n"].to_numpy(dtype=float))
    else:
        model.centres, model.values = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def _labels(labels: DataFrame) -> DataFrame:
    """One label for each id: the majority of its rows, ties counting as 1. Null ids or labels say nothing."""
    rows = labels.select(F.col("doc_id").cast("long").alias("_label_id"), F.col("quality").cast("double").alias("q")).filter("_label_id is not null and q is not null")
    return rows.groupBy("_label_id").agg((F.avg("q") >= 0.5).cast("int").alias("label"))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, score, predicted. Labels teach only where crc32 of the id as text modulo 5 is
    not 0; of those, remainder 4 calibrates and the others fit.

    Null and wordless texts have statistics of zero and a score like any. A null id is scored and teaches nothing;
    repeated rows are scored alike and each teaches. Without usable labels all scores are 0.5. Other columns are
    ignored. An empty table gives no rows."""
    stats = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), _statistics(F.col("text").cast("string")).alias("stats")), "statistics")
    fold = id_remainder("doc_id", 5)
    known = stats.filter(fold != 0).join(_labels(labels), F.col("doc_id") == F.col("_label_id")).select("stats", "label", (fold != 4).alias("fit"))
    model = train(known)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series(model.score(np.stack(x.to_numpy())) if len(x) else np.zeros(0))

    value = F.lit(0.5) if model is None else score("stats")
    out = stats.select("doc_id", value.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", F.coalesce(id_remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
