"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams, trained with
follow-the-regularised-leader and an elastic-net penalty, then calibrated by a temperature."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fresh_name, id_remainder, same_columns

NGRAMS = (1, 2, 3)
BUCKETS = 1 << 16
#: Labelled rows the classifier is fitted on: about this many for each language, MAX_TRAIN in all. Document
#: frequencies come from every row that may be learned from.
PER_LANGUAGE = 1500
MAX_TRAIN = 12_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
#: Code points handled at a time, whatever the length of a text.
CHUNK = 1 << 19
UNKNOWN = "und"
#: The commonest languages are learned, this many at most.
MAX_LANGUAGES = 512
#: The pipeline rejects a document whose calibrated probability is under this many times chance (of 1 / languages).
OVER_CHANCE = 1.2


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The hashed character n-grams of a whole text in lower case, as (buckets, counts)."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    counts = None
    longest = max(NGRAMS)
    for at in range(0, len(codes), CHUNK):
        part = codes[at : at + CHUNK + longest - 1].astype(np.uint32)
        hashes = []
        for n in NGRAMS:
            m = min(len(part) - n + 1, CHUNK)
            if m <= 0:
                continue
            h = np.full(m, n * 0x9E3779B1 & 0xFFFFFFFF, dtype=np.uint32)
            for j in range(n):
                h = (h ^ part[j : j + m]) * np.uint32(0x01000193)
                h ^= h >> np.uint32(15)
            hashes.append((h * np.uint32(0x9E3779B1)) >> np.uint32(16))
        here = np.bincount(np.concatenate(hashes), minlength=BUCKETS)
        counts = here if counts is None else counts + here
    if counts is None:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    found = np.flatnonzero(counts)
    return found, counts[found]


def tf_idf(buckets: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1.0 + np.log(counts)) * idf[buckets]
    norm = np.sqrt((x * x).sum())
    return (x / norm if norm else x).astype(np.float32)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # BUCKETS x languages
    bias: np.ndarray
    temperature: float

    def predict(self, text: str) -> tuple[str, float]:
        buckets, counts = ngram_counts(text)
        z = (tf_idf(buckets, counts, self.idf) @ self.weights[buckets] + self.bias) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by FTRL-proximal, one row at a time in a seeded order. L1 keeps weights at zero until their
    gradients add up to more than it."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))
    rng = np.random.default_rng(7)

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        w = -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2)
        return np.where(np.abs(zi) > L1, w, 0.0)

    for _ in range(epochs):
        for i in rng.permutation(len(rows)).tolist():
            buckets, x, y = rows[i]
            at, v = np.append(buckets, BUCKETS), np.append(x, np.float32(1))
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            s = v @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1.0
            g = v[:, None] * p[None, :]
            g2 = g * g
            z[at] = zi + g - (np.sqrt(ni + g2) - np.sqrt(ni)) / ALPHA * w
            n[at] = ni + g2
    w = weights(z, n)
    return w[:BUCKETS], w[BUCKETS]


def best_temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least negative log-likelihood, by golden-section search over its logarithm."""

    def loss(log_t: float) -> float:
        s = scores / np.exp(log_t)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), labels]).mean())

    if not len(scores):
        return 1.0
    low, high, r = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - r * (high - low), low + r * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(BUCKETS, dtype=np.int64), 0
    for batch in batches:
        for text in batch.column(0):
            df[ngram_counts(text.as_py())[0]] += 1
            n += 1
    found = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(found, -1), pa.int32()), pa.array(np.append(df[found], n), pa.int64())], names=["bucket", "n"])


def _features(idf: np.ndarray):
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(b.astype(np.int32), tf_idf(b, c, idf)) for b, c in (ngram_counts(t.as_py()) for t in batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([b.tobytes() for b, _ in rows], pa.binary()), pa.array([x.tobytes() for _, x in rows], pa.binary())], names=["draw", "label", "buckets", "x"]
            )

    return features


def _fit(classes: int):
    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["draw", "label"], kind="stable")
        data = [(np.frombuffer(b, np.int32), np.frombuffer(x, np.float32), int(y)) for b, x, y in zip(rows["buckets"], rows["x"], rows["label"], strict=True)]
        # Every fourth row calibrates; its weights come from the rest. The final weights use all rows.
        held = data[3::4]
        w, bias = ftrl([r for i, r in enumerate(data) if i % 4 != 3] or data, classes)
        scores = np.array([x @ w[b] + bias for b, x, _ in held]).reshape(-1, classes)
        t = best_temperature(scores, np.array([y for _, _, y in held], dtype=int))
        w, bias = ftrl(data, classes)
        return pd.DataFrame({"weights": [w.astype(np.float32).tobytes()], "bias": [bias.astype(np.float32).tobytes()], "temperature": [t]})

    return fit


def train(rows: DataFrame) -> Model | None:
    """rows: doc_id, text, lang, all of which may be learned from. Document frequencies are counted over all rows;
    the regression is fitted in one task on a bounded sample (PER_LANGUAGE, MAX_TRAIN), drawn by a hash of the row.
    Rows with null text or lang teach nothing, nor do those of languages beyond the MAX_LANGUAGES commonest. No usable
    rows give no model."""
    known = rows.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(3)).alias("draw"))
    known = known.filter("text is not null and lang is not null")
    commonest = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES)
    sizes = {r.lang: r.n for r in commonest.collect()}
    if not sizes:
        return None
    languages = sorted(sizes)
    counted = known.select("text").mapInArrow(_frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(BUCKETS)
    real = counted[counted["bucket"] >= 0]
    df[real["bucket"].to_numpy()] = real["n"].to_numpy()
    total = int(counted.loc[counted["bucket"] < 0, "n"].sum())
    idf = np.log((1.0 + total) / (1.0 + df)) + 1.0
    share = {k: min(1.0, min(PER_LANGUAGE, MAX_TRAIN / len(languages)) / n) for k, n in sizes.items()}
    chance = F.create_map(*[F.lit(v) for k in languages for v in (k, share[k])])
    number = F.create_map(*[F.lit(v) for k in languages for v in (k, languages.index(k))])
    u = (F.pmod(F.col("draw"), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    sample = known.filter(u < chance[F.col("lang")]).select("draw", number[F.col("lang")].alias("label"), "text")
    vectors = sample.mapInArrow(_features(idf), "draw long, label int, buckets binary, x binary").limit(2 * MAX_TRAIN)
    fitted = vectors.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(_fit(len(languages)), "weights binary, bias binary, temperature double").first()
    weights = np.frombuffer(fitted.weights, np.float32).reshape(BUCKETS, len(languages))
    return Model(languages, idf.astype(np.float32), weights, np.frombuffer(fitted.bias, np.float32), fitted.temperature)


def predict(docs: DataFrame, model: Model | None, name: str | None = None) -> DataFrame:
    """docs with a struct column `name` (lang_pred, score; fresh_name(docs, "_lang") unless given): the language of each
    whole text and its calibrated probability. Text that is null or has no letter is `und` with score 0, as is
    everything without a model. Of languages with equal scores the first by name is taken. Other columns pass through;
    repeated rows get equal results; an empty table gives no rows."""
    name = name or fresh_name(docs, "_lang")
    text = F.col("text").cast("string")
    lettered = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    if model is None:
        return docs.withColumn(name, F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score")))

    @F.pandas_udf("struct<lang_pred:string,score:double>")
    def identify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([(UNKNOWN, 0.0) if t is None else model.predict(t) for t in texts.tolist()], columns=["lang_pred", "score"])

    return docs.withColumn(name, identify.asNondeterministic()(F.when(lettered, text)))


def fold(docs: DataFrame) -> DataFrame:
    """The rows that may be learned from: crc32 of the id as text, modulo 3, is not 1 (null ids teach nothing)."""
    return docs.filter(id_remainder("doc_id", 3) != 1)


def keep_identified(docs: DataFrame, over_chance: float = OVER_CHANCE) -> DataFrame:
    """docs whose language is identified with a probability of over_chance / languages at least; the model learns from
    fold(docs). Without letters or without a model none is."""
    name = fresh_name(docs, "_lang")
    model = train(fold(docs).select("doc_id", "text", "lang"))
    least = min(1.0, over_chance / len(model.languages)) if model else 1.0
    found = predict(docs, model, name)
    return found.filter((F.col(f"{name}.lang_pred") != UNKNOWN) & (F.col(f"{name}.score") >= least)).select(*same_columns(docs))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(fold(docs).select("doc_id", "text", "lang"))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(id_remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "_lang.lang_pred", "_lang.score")
