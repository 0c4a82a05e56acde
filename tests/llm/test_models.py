"""The learned operators against plain re-computations: n-grams, FTRL, kernel ridge, isotonic fit, pattern scores."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tickforge.llm import langid, pii, quality_model

LETTERS = {"en": "etaoinshrdlu", "fr": "esaitnrulodé", "xx": "kzwyqjxv"}


def prose(lang, n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice(LETTERS[lang]) for _ in range(r.randrange(2, 8))) for _ in range(n))


# ---- language


def bucket(gram):
    h = len(gram) * 0x9E3779B1 & 0xFFFFFFFF
    for c in gram:
        h = (h ^ ord(c)) * 0x01000193 & 0xFFFFFFFF
        h ^= h >> 15
    return (h * 0x9E3779B1 & 0xFFFFFFFF) >> 16


def grams_of(text):
    t = text.lower()
    return Counter(bucket(t[i : i + n]) for n in (1, 2, 3) for i in range(len(t) - n + 1))


@pytest.mark.parametrize("text", ["", "a", "Ab", "Größe 😀 ab ab", prose("fr", 300, 1)])
def test_ngrams(text):
    found, counts = langid.ngram_counts(text)
    assert dict(zip(found.tolist(), counts.tolist(), strict=True)) == dict(grams_of(text))


def plain_ftrl(rows, classes, epochs):
    """FTRL-proximal a coordinate at a time: z adds gradients less sigma * w, n adds squares."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(i, k):
        if abs(z[i, k]) <= langid.L1:
            return 0.0
        return -(z[i, k] - math.copysign(langid.L1, z[i, k])) / ((langid.BETA + math.sqrt(n[i, k])) / langid.ALPHA + langid.L2)

    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for at in rng.permutation(len(rows)).tolist():
            features, y = rows[at]
            w = {(i, k): weight(i, k) for i in features for k in range(classes)}
            scores = [sum(v * w[i, k] for i, v in features.items()) for k in range(classes)]
            top = max(scores)
            total = sum(math.exp(s - top) for s in scores)
            for k in range(classes):
                error = math.exp(scores[k] - top) / total - (k == y)
                for i, v in features.items():
                    g = v * error
                    sigma = (math.sqrt(n[i, k] + g * g) - math.sqrt(n[i, k])) / langid.ALPHA
                    z[i, k] += g - sigma * w[i, k]
                    n[i, k] += g * g
    return weight


def test_ftrl():
    r = random.Random(3)
    rows = [({r.randrange(40): r.random() for _ in range(6)}, r.randrange(3)) for _ in range(120)]
    packed = [(np.array(sorted(f)), np.array([f[i] for i in sorted(f)]), y) for f, y in rows]
    weights, bias = langid.ftrl(packed, 3, epochs=2)
    weight = plain_ftrl([(f | {langid.BUCKETS: 1.0}, y) for f, y in rows], 3, 2)
    assert np.allclose(weights[:40], [[weight(i, k) for k in range(3)] for i in range(40)], atol=1e-9)
    assert np.allclose(bias, [weight(langid.BUCKETS, k) for k in range(3)], atol=1e-9)
    assert (weights[:40] == 0).any() and not weights[40:].any()


def test_language_model_against_a_plain_one(spark):
    rows = [(i, prose(("en", "fr", "xx")[i % 3], 12 + i % 9, i), ("en", "fr", "xx")[i % 3]) for i in range(90)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3))
    df = Counter(b for _, t, _ in rows for b in grams_of(t))
    idf = {b: math.log((1 + len(rows)) / (1 + n)) + 1 for b, n in df.items()}
    assert model.languages == ["en", "fr", "xx"] and np.allclose([model.idf[b] for b in idf], list(idf.values()), atol=1e-6)
    draw = {r.doc_id: r.d for r in spark.createDataFrame(rows, "doc_id long, text string, lang string").select("doc_id", F.xxhash64("doc_id", "text", F.lit(3)).alias("d")).collect()}

    def features(t):
        x = {b: (1 + math.log(c)) * idf[b] for b, c in grams_of(t).items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        return {b: v / norm for b, v in x.items()}

    data = [(features(t) | {langid.BUCKETS: 1.0}, model.languages.index(lang)) for i, t, lang in sorted(rows, key=lambda r: draw[r[0]])]
    weight = plain_ftrl(data, 3, langid.EPOCHS)
    some = random.Random(1).sample(sorted(idf), 60)
    assert np.allclose(model.weights[some], [[weight(b, k) for k in range(3)] for b in some], atol=2e-4)
    for _, t, _ in rows[:10]:
        x = features(t)
        s = [(weight(langid.BUCKETS, k) + sum(v * weight(b, k) for b, v in x.items())) / model.temperature for k in range(3)]
        p = np.exp(s) / np.exp(s).sum()
        lang, score = model.predict(t)
        assert lang == model.languages[int(p.argmax())] and abs(score - p.max()) < 1e-3


def test_language_query(spark, tmp_path):
    rows = [(i, prose(("en", "fr")[i % 2], 30, i), ("en", "fr")[i % 2], "s", 0) for i in range(150)] + [(1000, None, "en", "s", 0), (1001, "12 34", "fr", "s", 0), (None, prose("en", 30, 5), None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = langid.query(spark, str(tmp_path))
    assert out.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"] and dict(out.dtypes)["held_out"] == "boolean"
    got = {g.doc_id: g for g in out.collect()}
    model = langid.train(langid.fold(docs).select("doc_id", "text", "lang"))
    for i, t, lang, *_ in rows:
        g = got[i]
        assert g.held_out == (i is not None and zlib.crc32(str(i).encode()) % 3 == 1)
        want = ("und", 0.0) if t is None or not re.search("[a-zé]", t) else model.predict(t)
        assert g.lang_pred == want[0] and abs(g.score - want[1]) < 1e-6
        assert lang is None or want[0] in (lang, "und")


def test_unlearned_languages_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 2)
    rows = [(i, prose("en", 9, i), "en") for i in range(9)] + [(20 + i, prose("fr", 9, i), "fr") for i in range(8)] + [(40, "kz", "xx")]
    assert langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string")).languages == ["en", "fr"]


# ---- quality


def pools(x, y, w):
    """Isotonic regression by its min-max formula: the greatest over starts of the least mean over ends."""
    mean = lambda a, b: sum(w[i] * y[i] for i in range(a, b + 1)) / sum(w[a : b + 1])
    return [max(min(mean(a, b) for b in range(i, len(x))) for a in range(i + 1)) for i in range(len(x))]


def test_isotonic_against_the_formula():
    r = np.random.default_rng(3)
    for _ in range(20):
        x, y, w = np.sort(r.random(25)), r.integers(0, 2, 25).astype(float), r.integers(1, 9, 25).astype(float)
        centres, values = quality_model.isotonic(x, y, w)
        want = pools(x.tolist(), y.tolist(), w.tolist())
        assert np.allclose(values, sorted(set(np.round(want, 12))), atol=1e-9)
        for c, v in zip(centres, values, strict=True):
            mine = [i for i in range(25) if abs(want[i] - v) < 1e-9]
            assert abs(c - np.average(x[mine], weights=w[mine])) < 1e-9


def test_statistics():
    text = "Hello, hello world!\n\nA|b 12 #\nHello, hello world!\nno stop"
    s = quality_model.statistics(text)
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    chars = sum(map(len, words))
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    want = [
        math.log1p(len(words)), np.mean([len(w) for w in words]), np.std([len(w) for w in words]), 3 / 38, 2 / chars, 2 / chars, 2 / chars, 2 / chars,
        len(set(words)) / len(words), len(set(triples)) / len(triples), 3 / 4, 2 / 4, math.log1p(len(words) / 4), 1 / len(words), 0.0, math.log1p(4),
    ]
    assert np.allclose(s, want) and quality_model.statistics(None) == quality_model.statistics(" \n") == [0.0] * quality_model.STATS


def test_ridge_on_features_approximates_kernel_ridge():
    r = np.random.default_rng(5)
    x, y = r.normal(size=(80, 4)), r.integers(0, 2, 80).astype(float)
    phi = quality_model.Fourier(np.zeros(4), np.ones(4), features=20_000, gamma=0.1)(x)[:, :-1]
    kernel = np.exp(-0.1 * ((x[:, None] - x[None]) ** 2).sum(-1))
    exact = kernel @ np.linalg.solve(kernel + 0.5 * np.eye(80), y)
    ours = phi @ phi.T @ np.linalg.solve(phi @ phi.T + 0.5 * np.eye(80), y)
    assert np.abs(exact - ours).max() < 0.05


def test_quality_query_against_a_whole_fit(spark, tmp_path):
    r = random.Random(4)
    rows = [(i, prose("en", r.randrange(5, 60), i) + (" !!! ### BUY" * (i % 7) if i % 3 == 0 else "."), None, "s", 0) for i in range(400)]
    rows += [(1000, None, None, None, None), (1001, "", "en", "s", 0), (None, "no id", "en", "s", 0), (1002, "word " * 200_000, "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(i % 3 != 0 or r.random() < 0.1), 0) for i in range(380)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = quality_model.query(spark, str(tmp_path))
    assert out.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    got = {g.doc_id: g for g in out.collect()}
    assert len(got) == len(rows)

    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    stats = {i: np.array(quality_model.statistics(t)) for i, t, *_ in rows}
    label = {i: q for i, q, _ in labels if fold(i) != 0}
    fit, rest = [i for i in label if fold(i) != 4], [i for i in label if fold(i) == 4]
    x, y = np.stack([stats[i] for i in fit]), np.array([label[i] for i in fit], dtype=float)
    fourier = quality_model.Fourier(x.mean(axis=0), x.std(axis=0))
    phi = fourier(x)
    ridge = quality_model.RIDGE * len(fit) * np.eye(phi.shape[1])
    ridge[-1, -1] = 1e-9
    w = np.linalg.solve(phi.T @ phi + ridge, phi.T @ y)
    raw = {i: float((fourier(s[None]) @ w)[0]) for i, s in stats.items()}
    bins = defaultdict(list)
    for i in rest:
        bins[math.floor(min(1.5, max(-0.5, raw[i])) * quality_model.BINS / 2)].append(i)
    points = sorted((np.mean([raw[i] for i in b]), np.mean([label[i] for i in b]), len(b)) for b in bins.values())
    want = pools([p[0] for p in points], [p[1] for p in points], [p[2] for p in points])
    centres = [(np.average([p[0] for p, v in zip(points, want, strict=True) if abs(v - u) < 1e-9], weights=[p[2] for p, v in zip(points, want, strict=True) if abs(v - u) < 1e-9]), u) for u in sorted(set(np.round(want, 12)))]
    for i, *_ in rows:
        level = np.interp(raw[i], [c for c, _ in centres], [v for _, v in centres])
        score = 0.999 * level + 0.001 / (1 + math.exp(-raw[i]))
        assert abs(got[i].score - score) < 1e-4 and got[i].predicted == int(got[i].score >= 0.3)
        assert got[i].held_out == (i is not None and fold(i) == 0)


# ---- personal data


def plain_scores(edges):
    """The certainty of patterns for kinds, by dictionaries: see pii._score_patterns."""
    values, known, others = defaultdict(set), defaultdict(set), defaultdict(set)
    for pattern, kind, value in edges:
        values[pattern].add(value)
        if kind == "other":
            others[pattern].add(value)
        else:
            known[pattern, kind].add(value)
    patterns_of = defaultdict(set)
    for pattern, vs in others.items():
        for v in vs:
            patterns_of[v].add(pattern)
    base = {k: len(v) for k, v in known.items()}
    sure, before = {}, 0
    while True:
        seeds, certain = Counter(), Counter()
        for k, n in base.items():
            seeds[k] += n
            certain[k] += n
        for (v, kind), s in sure.items():
            for p in patterns_of[v]:
                seeds[p, kind] += 1
                certain[p, kind] += s
        counted = [k for k in seeds if seeds[k] >= pii.MIN_SEEDS]
        score = {k: certain[k] / (len(values[k[0]]) + pii.PRIOR) for k in counted}

        def of_values():
            best = defaultdict(float)
            for (p, kind), s in score.items():
                for v in others[p]:
                    best[v, kind] = max(best[v, kind], s)
            return best

        live = {p for p, _ in counted}
        for _ in range(pii.ROUNDS):
            best = of_values()
            gain = {(p, kind): sum(best.get((v, kind), 0.0) for v in others[p]) for p, kind in counted if p in live}
            score = {k: round((base.get(k, 0) + gain[k]) / (len(values[k[0]]) + pii.PRIOR), 9) for k in counted}
        sure = {k: s for k, s in of_values().items() if s >= pii.MIN_SURE}
        if len(sure) <= before:
            return score
        before = len(sure)


@pytest.mark.parametrize("seed", range(4))
def test_pattern_scores(spark, seed):
    r = random.Random(seed)
    edges = {(f"p{r.randrange(12)}", r.choice(["email", "phone", "other", "other"]), f"v{r.randrange(30)}") for _ in range(160)}
    # A chain of contexts, each reached only by what the one before found.
    for k in range(3):
        edges |= {(f"chain{k}", "phone" if k == 0 else "other", f"c{k}{i}") for i in range(30)} | {(f"chain{k}", "other", f"c{k + 1}{i}") for i in range(4)}
    df = spark.createDataFrame(sorted(edges), "pattern string, kind string, value string")
    got = {(g.pattern, g.kind): g.score for g in pii._score_patterns(df).collect()}
    want = plain_scores(edges)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    assert ("chain1", "phone") in got
