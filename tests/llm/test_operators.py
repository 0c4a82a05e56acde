"""The corpus operators against brute force, on small tables with nulls, empty and long texts, ties and repeats."""

import base64
import gzip
import hashlib
import io
import random
import re
import zlib

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tickforge.llm import common, decontam, langid, mixing, near_copies, pii, quality_model, quality_rules, sharding, simhash, url_filter, warc
from tickforge.llm.components import connected_components

#: Columns of documents, and further ones with names that operators use for their own.
CLASHES = (
    "score _lang shard kept _leak copies size slot _first _times _row _fp _first_id _first_n _key _tie _range _nth _piece _rows"
    " _slot _in _k_domain _m_source _key_domain _leaf_source _text_h _text_c _hit_n _hit_items _h _c h c fp n bands text_key verdict _rules"
).split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)
WORDS = {"en": "the of and to in is that it was for on with as his at by this".split(), "fr": "le la les de des un une et est que qui dans pour sur avec où".split()}


def text_of(lang, n, seed):
    r = random.Random(seed)
    words = [r.choice(WORDS[lang]) + r.choice(WORDS[lang]) for _ in range(n)]
    return ". ".join(" ".join(words[i : i + 9]) for i in range(0, n, 9)) + "."


@pytest.fixture(scope="module")
def rows():
    out = []
    for i in range(120):
        lang = "en" if i % 3 else "fr"
        out.append((i, text_of(lang, 20 + i, i), lang, f"src{i % 7}"))
    copy = out[5][1]
    out += [(200 + i, copy, "en", "src0") for i in range(8)]
    out += [(300, copy.replace(".", " ."), "en", "src0"), (301, None, None, None), (302, "", "en", "src1"), (None, "no id here", None, "src1"), (303, " \t\n", "fr", None), (304, "12345 +++ !!!", None, "src2")]
    out += [(305, text_of("en", 30_000, 99), "en", "src3"), (7, out[7][1], "en", "src0"), (7, out[7][1], "en", "src0"), (306, "x" * 200_000, None, "src3")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, len(r[1] or ""), *CLASHES) for r in rows], SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


BENCH = "item_id long, text string"


def words_of(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))


# ---- components and SimHash


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(50)] + [(100 + i, 101 + i) for i in range(40)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {x.node: x.root for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bk_tree():
    r = random.Random(1)
    values = list({r.getrandbits(12) for _ in range(300)})
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for q in values[:50]:
        assert sorted(tree.values[i] for i in tree.search(q, 2)) == sorted(v for v in values if (v ^ q).bit_count() <= 2)


def fingerprints_near(centres, each, spread, seed):
    r = random.Random(seed)
    out = set()
    for _ in range(centres):
        base = r.getrandbits(64)
        for _ in range(each):
            value = base
            for _ in range(spread):
                value ^= 1 << r.randrange(64)
            out.add(value)
    return sorted(out)


@pytest.mark.parametrize(("tree", "max_tree", "fps"), [
    (256, 2048, fingerprints_near(40, 8, 2, 5)), (8, 2048, fingerprints_near(40, 8, 2, 5)), (8, 3, fingerprints_near(40, 8, 2, 5)),
    (64, 16, fingerprints_near(1, 300, 3, 6)), (4, 30, list(range(200))), (1, 1, [0, 1, 2, 4, 7]), (4, 4, [5]),
])
def test_near_links(spark, tree, max_tree, fps):
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp long"), tree=tree, max_tree=max_tree).collect()
    group = {x: x for x in fps}

    def find(g, x):
        while g[x] != x:
            x = g[x]
        return x

    want, have = dict(group), dict(group)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 2:
                p, q = find(want, a), find(want, b)
                want[max(p, q)] = min(p, q)
    for a, b in links:
        a, b = a % (1 << 64), b % (1 << 64)
        assert (a ^ b).bit_count() <= 2
        p, q = find(have, a), find(have, b)
        have[max(p, q)] = min(p, q)
    assert {x: find(want, x) for x in fps} == {x: find(have, x) for x in fps}


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_shards_hold_every_near_pair_and_are_bounded(spark, radius):
    fps = fingerprints_near(6, 60, 2, 4)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    met, largest, trees = set(), 0, 0
    for table in simhash._shards(df, radius, 16, 24):
        shards = {}
        for s in table.collect():
            shards.setdefault((s.mask, s.shard), []).append(s.fp % (1 << 64))
        for members in shards.values():
            assert len(members) == len(set(members))
            largest, trees = max(largest, len(members)), trees + (len(members) > 2)
            met |= {(a, b) for a in members for b in members if a < b}
    assert {(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= radius} <= met
    assert largest <= 24 and trees > 5


def fingerprint(t):
    ws = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (t or "").encode()))
    if not ws:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(ws[i : i + 3]), 42) for i in range(max(1, len(ws) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_near_duplicates(docs, rows, empty):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    fps = {(r[0], fingerprint(r[1])) for r in rows}
    assert {(g.doc_id, g.fp % (1 << 64)) for g in got} == fps
    component = {g.doc_id: g.component_id for g in got}
    assert all(component[i] == 5 for i in range(200, 208)) and component[5] == 5
    assert component[301] == component[302] == component[303] == 301
    kept = simhash.one_of_each_group(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and 5 in ids and 7 in ids and not set(ids) & {*range(200, 208), 302, 303}
    assert simhash.near_duplicates(empty).count() == 0 and simhash.one_of_each_group(empty).count() == 0


def five_word_sets(texts):
    out = []
    for t in texts:
        ws = (t or "").lower().split()
        out.append({tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set())
    return out


def test_near_dedup_stage_drops_edited_copies(spark, docs, rows, empty):
    r = random.Random(12)
    texts = [text_of("en", 150, 500 + i) for i in range(12)]
    for i in range(12):
        chain = texts[i]
        for k in range(14):
            ws = (chain if k > 7 else texts[i]).split()
            for _ in range(1 + k % 8):
                ws[r.randrange(len(ws))] = f"edit{r.randrange(10**6)}"
            chain = " ".join(ws)
            texts.append(chain)
    texts += [texts[0].upper(), "one two", "One  two", "one three", None, "", texts[3] + " " + texts[4], "a b c d e f g h i j", "a b c d e f g h i k"]
    sets, group = five_word_sets(texts), list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    kept = {x.doc_id for x in corpus_pipeline.drop_near_duplicates(spark, df, "").collect()}
    assert kept == set(group) and 20 < len(kept) < len(texts) - 60
    ids = [x.doc_id for x in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    assert ids.count(7) == 1 and ids.count(None) == 1 and 5 in ids and not set(ids) & {*range(200, 208), 302, 303}
    assert corpus_pipeline.drop_near_duplicates(spark, empty, "").columns == docs.columns and corpus_pipeline.drop_near_duplicates(spark, empty, "").count() == 0


def test_near_dedup_stage_links_by_trees_before_bands(spark, monkeypatch):
    r = random.Random(4)
    texts = [text_of("en", 3000, 900 + i) for i in range(6)]
    texts += [" ".join(["edit", *t.split()[1:]]) for t in texts] + [text_of("fr", 40, 7), text_of("fr", 40, 8)]
    hashes = [near_copies.simhash_of(near_copies.shingles_of(t)) % (1 << 64) for t in texts]
    for t, h in zip(texts, hashes, strict=True):
        votes = near_copies.shingles_of(t).tolist()
        ones = [2 * sum(v.to_bytes(8, "little")[b // 8] >> (7 - b % 8) & 1 for v in votes) > len(votes) for b in range(64)]
        assert h.to_bytes(8, "little") == bytes(sum(ones[8 * k + b] << (7 - b) for b in range(8)) for k in range(8))
    close = [(i, i + 6) for i in range(6) if (hashes[i] ^ hashes[i + 6]).bit_count() <= near_copies.TREE_RADIUS]
    assert len(close) > 3
    rows = list(enumerate(texts))
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(near_copies, "_proposals", lambda similarity: lambda batches: iter(()))  # no bands
    kept = {x.doc_id for x in corpus_pipeline.drop_near_duplicates(spark, df, "").collect()}
    assert kept == set(range(len(texts))) - {j for _, j in close}


def test_tree_pairs_are_links_only_if_the_sets_are_alike(spark):
    sets = spark.createDataFrame([(1, 0b0), (2, 0b0), (3, 0b111), (4, 0b1111 << 40), (5, -1)], "fp long, simhash long")
    assert {tuple(x) for x in near_copies.tree_pairs(sets).collect()} == {(1, 2), (1, 3)}
    a, b = ([np.uint64(x) for x in range(k, k + 10)] for k in (0, 3))
    pairs = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), *(pa.array([np.array(x).tobytes()]) for x in (a, b))], names=["a", "b", "s", "t"])
    assert [x.num_rows for x in near_copies._confirm(0.8)(iter([pairs]))] == [0]


def test_sifted_loses_no_key_and_spares_the_shuffle(spark, monkeypatch):
    rows = [(i, "x" * (i % 7), "c") for i in range(-500, 3000)] + [(None, "n", "c"), (7, "twice", "c")]
    df = spark.createDataFrame(rows, "id long, _at string, _bits string").repartition(5)
    for bits, most in ((common.SIEVE_BITS, 520), (1 << 16, 1000), (common.BITMAP, 3300)):
        monkeypatch.setattr(common, "SIEVE_BITS", bits)
        maybe, rest = common.sifted(df, F.col("id"), spark.range(-100, 400))
        hit = {x.id for x in maybe.collect()}
        assert maybe.columns == rest.columns == df.columns
        assert set(range(-100, 400)) <= hit and None not in hit and maybe.count() < most
        assert sorted(map(str, maybe.collect() + rest.collect())) == sorted(map(str, df.collect()))
    none, rest = common.sifted(df, F.col("id"), spark.range(0))
    assert none.count() == 0 and rest.count() == len(rows)


def test_one_of_each_group_shuffles_only_rows_that_may_go(spark, monkeypatch):
    rows = [(i, f"text {i}") for i in range(300)] + [(i, "text 5") for i in range(300, 320)] + [(8, "text 8"), (9, "another"), (None, "text 3"), (None, "alone"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    seen = []
    keep = simhash.sifted
    monkeypatch.setattr(simhash, "sifted", lambda *a: seen.append(keep(*a)) or seen[-1])
    found = lambda d: spark.createDataFrame([(i, hash(t or "") % 10**9, 9 if t == "another" else None if i is None and t != "text 3" else 5 if t == "text 5" else 3 if t == "text 3" else i) for i, t in rows], "doc_id long, fp long, component_id long")
    out = simhash.one_of_each_group(docs, found, lambda t: hash(t or "") % 10**9).collect()
    assert sorted((x.doc_id, x.text) for x in out if x.doc_id is not None and x.doc_id != 9) == [(i, f"text {i}") for i in range(300) if i != 9]
    assert sum(x.doc_id == 9 for x in out) == 1
    ((maybe, staying),) = seen
    assert maybe.count() <= 26 and {x.doc_id for x in maybe.collect()} >= {8, 9, *range(300, 320)} and staying.count() >= 295


# ---- decontamination


def brute(texts, items):
    out = []
    for t in texts:
        ws, hit, found = words_of(t), set(), set()
        for item, text in items:
            iw = words_of(text)
            n = min(10, len(iw))
            windows = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)} if iw else set()
            for i in range(len(ws) - n + 1) if n else ():
                if tuple(ws[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found.add(str(item))
        out.append((len(ws), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_contaminated(spark, docs, rows, block_bytes):
    r = random.Random(2)
    items = [(i, text_of("en", 15 + i, 1000 + i)) for i in range(12)] + [(50, "Zebra, quagga"), (51, ""), (52, None), (53, " ".join(["la"] * 12)), (50, "Zebra, quagga")]
    texts = [x[1] for x in rows[:40]]
    for k in range(40):
        ws = texts[k].split()
        cut = items[k % 12][1].split()[3 : 3 + r.choice([8, 9, 10, 11, 14])]
        texts[k] = " ".join([*ws[:7], *cut, *ws[7:]]).upper() if k % 2 else " ".join([*ws, *cut])
    texts += ["zebra; quagga zebra quagga", "la " * 30, None, "", "é " * 50]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, n_words string")
    bench = spark.createDataFrame(items, BENCH)
    got = {g.doc_id: (g._leak.n_words, g._leak.n_hit, sorted(g._leak["items"])) for g in decontam.contaminated(df, bench, block_bytes).collect()}
    assert got == dict(enumerate(brute(texts, items)))
    clashing = decontam.contaminated(docs, bench, block_bytes)
    assert clashing.columns == [*docs.columns, "__leak"] and clashing.count() == len(rows)
    assert {tuple(g[c] for c in CLASHES) for g in clashing.collect()} == {tuple(CLASHES)}
    none = spark.createDataFrame([], df.schema)
    assert decontam.contaminated(none, bench, block_bytes).count() == 0
    kept = decontam.drop_contaminated(docs, spark.createDataFrame([(1, rows[9][1])], BENCH))
    assert kept.columns == docs.columns and 9 not in {x.doc_id for x in kept.collect()}
    assert decontam.drop_contaminated(docs, spark.createDataFrame([], BENCH)).count() == len(rows)


@pytest.mark.parametrize("block_bytes", [1 << 20, 100])
def test_items_without_id_contaminate(spark, block_bytes):
    items = [(None, text_of("en", 20, 1)), (None, text_of("en", 20, 2)), (7, text_of("en", 20, 3))]
    df = spark.createDataFrame([(i, f"before {t} after") for i, (_, t) in enumerate(items)] + [(3, "clean")], "doc_id long, text string")
    got = {g.doc_id: (g._leak.n_hit, list(g._leak["items"])) for g in decontam.contaminated(df, spark.createDataFrame(items, BENCH), block_bytes).collect()}
    assert got == {0: (20, []), 1: (20, []), 2: (20, ["7"]), 3: (0, [])}


def test_winnow_guarantee():
    r = np.random.default_rng(4)
    h = r.integers(0, 1 << 40, 500).astype(np.uint64)
    kept = set(decontam.winnow(h, 6).tolist())
    assert all(any(j in kept for j in range(i, i + 6)) for i in range(len(h) - 5))


# ---- sharding, mixing


def test_shard(docs, rows, empty):
    got = sharding.shard(docs)
    assert got.columns == [*docs.columns, "_size", "text_crc32", "_shard", "__slot"]
    assert {tuple(g[c] for c in CLASHES) for g in got.collect()} == {tuple(CLASHES)}
    got = got.select("doc_id", "text", F.col("_size").alias("size"), "text_crc32", "_shard", F.col("__slot").alias("slot")).collect()
    assert len(got) == len(rows)
    total = sum(len((t or "").encode()) + 8 for _, t, *_ in rows)
    biggest = max(len((t or "").encode()) + 8 for _, t, *_ in rows)
    by = {}
    for g in got:
        assert g.size == len((g.text or "").encode()) + 8 and g.text_crc32 == zlib.crc32((g.text or "").encode())
        by.setdefault(g["_shard"], []).append(g)
    for members in by.values():
        assert sorted(g.slot for g in members) == list(range(len(members)))
        assert abs(sum(g.size for g in members) - total / 24) <= 2 * biggest
    assert set(by) <= set(range(24))
    order = [(g["_shard"], g.slot) for g in sorted(got, key=lambda g: (g.doc_id is not None, g.doc_id or 0, g["_shard"], g.slot))]
    assert order == sorted(order)
    assert sharding.shard(empty).count() == 0


def uneven(spark, n=3000):
    """Sizes that vary a hundredfold and ids that cluster."""
    return spark.range(n).select((F.col("id") * F.col("id") % 1009 + F.col("id")).alias("doc_id"), F.repeat(F.lit("ab"), (F.col("id") % 90).cast("int")).alias("text"), "id")


def by_shard(out):
    return out.groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.max("slot").alias("m"), F.countDistinct("slot").alias("d")).collect()


@pytest.mark.parametrize("samples", [1, 16])
def test_overfull_ranges_are_subdivided(spark, monkeypatch, samples):
    monkeypatch.setattr(sharding, "SAMPLES_PER_RANGE", samples)
    got = by_shard(sharding.shard(uneven(spark), 8))
    assert len(got) == 8 and sum(g.n for g in got) == 3000 and all(g.m == g.n - 1 == g.d - 1 for g in got)
    total = sum(g.b for g in got)
    assert max(abs(g.b - total / 8) for g in got) <= 2 * sharding.OVERFULL * max(188, total / (8 * sharding.RANGES_PER_SHARD))


def test_shards_are_unions_of_the_sampled_ranges(spark, monkeypatch):
    df = uneven(spark)
    drawn = sharding.splitters
    monkeypatch.setattr(sharding, "RANGES_PER_SHARD", 4)
    monkeypatch.setattr(sharding, "OVERFULL", 1e9)

    def shards():
        return {g.id: g.shard for g in sharding.shard(df, 8).select("id", "shard").collect()}

    once = shards()
    monkeypatch.setattr(sharding, "splitters", lambda slim, total, n, seed: drawn(slim, total, n, seed + 1))
    assert shards() != once
    # Two splitters make three ranges, each wholly in one shard; a constant makes two.
    monkeypatch.setattr(sharding, "splitters", lambda slim, total, n, seed: [(500, 0), (2000, 0)])
    held, ids = shards(), {r.id: r.doc_id for r in df.collect()}
    by_range = [{held[i] for i, k in ids.items() if a <= k < b} for a, b in ((-1, 500), (500, 2000), (2000, 10**9))]
    assert [len(s) for s in by_range] == [1, 1, 1] and len(set.union(*by_range)) == 3


def test_allot_against_brute_force():
    r = random.Random(4)
    for _ in range(200):
        held = []
        for i in range(r.randrange(1, 40)):
            rows, single = r.choice([1, 1, 5, 400]), r.random() < 0.4
            held.append(sharding.Range(i, rows * r.randrange(8, 90) if single else rows * 8 + r.randrange(500), rows, single))
        n = r.randrange(1, 9)
        pieces = sharding.allot(held, n)
        total, before, filled = sum(h.size for h in held), 0, [0] * n
        for h in held:
            mine = [p for p in pieces if p.range == h.number]
            assert sum(p.rows for p in mine) == h.rows and [p.first for p in mine] == [sum(q.rows for q in mine[:i]) for i in range(len(mine))]
            assert len(mine) == 1 or h.single
            for p in mine:
                assert p.slot == filled[p.shard]
                filled[p.shard] += p.rows
                middle = before + h.size * (2 * p.first + p.rows) / (2 * h.rows)
                assert abs(p.shard - min(n - 1, int(middle * n / total))) <= (abs(middle * n / total - round(middle * n / total)) < 1e-6)
            before += h.size
        order = [p.shard for p in pieces]
        assert order == sorted(order)


def test_rows_that_repeat_by_the_thousand_are_dealt_out(spark):
    rows = spark.range(4000).select(F.when(F.col("id") < 3000, 7).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") < 3000, "same text").otherwise(F.concat(F.lit("t"), "id")).alias("text"), F.lit("x").alias("shard"))
    out = sharding.shard(rows, 8)
    assert out.columns == ["doc_id", "text", "shard", "size", "text_crc32", "_shard", "slot"]
    got = by_shard(out.select("size", F.col("_shard").alias("shard"), "slot"))
    assert len(got) == 8 and sum(g.n for g in got) == 4000 and all(g.m == g.n - 1 == g.d - 1 for g in got)
    assert max(g.b for g in got) <= 1.1 * min(g.b for g in got)
    same = out.filter("doc_id = 7").collect()
    assert len(same) == 3000 and {(g.text, g.shard, g.size) for g in same} == {("same text", "x", 17)}


def level(budget, children):
    """Water-filling by repetition: saturate who is below the level, share the rest."""
    got, left, open_ = {}, budget, dict(children)
    while open_:
        unit = left / sum(w for _, w in open_.values())
        full = {k: c for k, (c, w) in open_.items() if c <= w * unit}
        if not full:
            return got | {k: w * unit for k, (c, w) in open_.items()}
        for k, c in full.items():
            got[k], left = c, left - c
            del open_[k]
    return got


def test_a_weight_of_zero_switches_off(spark):
    docs = spark.createDataFrame([(i, "a b c d", "en" if i % 2 else "fr", f"s{i % 3}") for i in range(48)] + [(99, None, "fr", "s0")], "doc_id long, text string, lang string, source string")
    taken = lambda mix: {r.doc_id: r.copies for r in mixing.mix_documents(docs, mix).collect()}
    got = taken(mixing.Mix(languages={"en": 1, "fr": 0}, budget_percent=40, max_epochs=1))
    assert not any(c for i, c in got.items() if i % 2 == 0 or i == 99) and 10 <= sum(got.values()) <= 19
    assert not any(c for i, c in taken(mixing.Mix(sources={"s1": 0}, max_epochs=1)).items() if i % 3 == 1)
    assert not any(taken(mixing.Mix(domains={}, other=0)).values())
    only = taken(mixing.Mix(languages={"en": 1, "fr": 0}, budget_percent=100, max_epochs=1))
    assert sum(only.values()) == 24 and all(only[i] for i in range(1, 48, 2))


def test_mix(docs, rows, empty):
    mix = mixing.Mix(budget_percent=50)
    out = mixing.mix_documents(docs, mix)
    name = out.columns[-1]
    assert out.columns == [*docs.columns, "_copies"] and {tuple(g[c] for c in CLASHES) for g in out.collect()} == {tuple(CLASHES)}
    got = out.select("doc_id", "text", "lang", "source", F.col(name).alias("c"), mixing.domain_of(F.col("source")).alias("dom")).collect()
    assert len(got) == len(rows)
    tokens = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    tree = {}
    for g in got:
        leaf = tree.setdefault(g.dom, {}).setdefault(g.lang or "", {})
        leaf[g.source or ""] = leaf.get(g.source or "", 0) + tokens(g.text)
    total = sum(t for d in tree.values() for la in d.values() for t in la.values())
    domains = level(total * 50 / 100, {d: (2 * sum(sum(la.values()) for la in x.values()), mix.domains.get(d, 10)) for d, x in tree.items()})
    for d, x in tree.items():
        langs = level(domains[d], {la: (2 * sum(y.values()), mix.languages.get(la, 10)) for la, y in x.items()})
        for la, y in x.items():
            budgets = level(langs[la], {s: (2 * t, 10) for s, t in y.items()})
            for s, t in y.items():
                mine = [g for g in got if (g.dom, g.lang or "", g.source or "") == (d, la, s)]
                taken, longest = sum(g.c * tokens(g.text) for g in mine), max(tokens(g.text) for g in mine)
                assert budgets[s] - longest * 3 - 4 <= taken <= budgets[s] + 1e-6
                assert max(g.c for g in mine) - min(g.c for g in mine) <= 1
    assert mixing.mixed(docs, mix).columns == docs.columns and mixing.mixed(empty).count() == 0
    again = {(g.doc_id, g.text): g[name] for g in mixing.mix_documents(docs.repartition(3), mix).collect()}
    assert again == {(g.doc_id, g.text): g.c for g in got}


# ---- language, quality


def test_language(docs, rows, empty):
    model = langid.train(langid.fold(docs).select("doc_id", "text", "lang"))
    assert set(model.languages) == {"en", "fr"} and model.temperature > 0
    got = {(g.doc_id, g.text): g["_l"] for g in langid.predict(docs, model, "_l").collect()}
    held = [r for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 1 and r[2] and len(r[1]) > 50]
    assert np.mean([got[r[0], r[1]].lang_pred == r[2] for r in held]) > 0.95
    assert all(0 <= g.score <= 1 for g in got.values())
    for i, t in ((301, None), (302, ""), (303, " \t\n"), (304, "12345 +++ !!!")):
        assert got[i, t].lang_pred == "und" and got[i, t].score == 0
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= set(range(120))
    assert langid.keep_identified(empty).count() == 0
    none = langid.predict(docs, langid.train(docs.filter("lang = 'xx'").select("doc_id", "text", "lang")), "_l")
    assert {g["_l"].lang_pred for g in none.collect()} == {"und"}


def test_l1_makes_weights_zero(docs):
    model = langid.train(docs.select("doc_id", "text", "lang"))
    assert 0.5 < (model.weights == 0).mean() < 1


def test_temperature():
    r = np.random.default_rng(0)
    z = r.normal(size=(4000, 3))
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    y = np.array([r.choice(3, p=q) for q in p])
    assert abs(langid.best_temperature(3 * z, y) - 3) < 0.3


def test_ngrams_of_long_text_in_chunks(monkeypatch):
    text = text_of("fr", 400, 3)
    want = langid.ngram_counts(text)
    monkeypatch.setattr(langid, "CHUNK", 100)
    got = langid.ngram_counts(text)
    assert (want[0] == got[0]).all() and (want[1] == got[1]).all()


def test_quality(spark, empty):
    good = [(i, text_of("en", 60 + i, i)) for i in range(150)]
    bad = [(1000 + i, " ".join(w.upper() + "!!" for w in text_of("en", 60 + i, i).split())) for i in range(80)]
    odd = [(5000, None), (5001, ""), (None, "a b c"), (3, good[3][1])]
    docs = spark.createDataFrame([(*x, "s") for x in good + bad + odd], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, 1, None) for i, _ in good] + [(i, 0, 1) for i, _ in bad] + [(None, 1, 0), (5000, None, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality_model.score_documents(docs, labels).collect()
    assert len(got) == len(good + bad + odd) and all(0 <= g.score <= 1 and g.predicted == int(g.score >= 0.3) for g in got)
    held = [g for g in got if g.doc_id is not None and g.doc_id < 2000 and zlib.crc32(str(g.doc_id).encode()) % 5 == 0]
    assert np.mean([g.predicted == (g.doc_id < 1000) for g in held]) > 0.97
    assert {g.score for g in quality_model.score_documents(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_model.score_documents(empty, labels).count() == 0


def test_isotonic():
    r = np.random.default_rng(1)
    x, y = np.sort(r.random(60)), r.random(60)
    _, v = quality_model.isotonic(x, y, np.ones(60))
    assert (np.diff(v) > 0).all() and v.min() >= y.min() and v.max() <= y.max()


def test_fourier_features_approximate_the_kernel():
    r = np.random.default_rng(2)
    x = r.normal(size=(30, 5))
    phi = quality_model.Fourier(np.zeros(5), np.ones(5), features=8000, gamma=0.1)(x)[:, :-1]
    want = np.exp(-0.1 * ((x[:, None] - x[None]) ** 2).sum(-1))
    assert np.abs(phi @ phi.T - want).max() < 0.08


# ---- rules, PII, URLs, WARC


def test_rules(docs, rows, empty):
    name = quality_rules.measure(docs).columns[-1]
    got = {(g.doc_id, g.text): g[name] for g in quality_rules.measure(docs).collect()}
    for i, t, *_ in rows:
        ws = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        at = {}
        for k in range(len(ws) - 2):
            at.setdefault(tuple(ws[k : k + 3]), []).append(k)
        again = {p + j for v in at.values() if len(v) > 1 for p in v for j in range(3)}
        g = got[i, t]
        assert (g.n_words, g.word_chars, g.n_dup_lines, g.n_repeat_words) == (len(ws), sum(map(len, ws)), len(lines) - len(set(lines)), len(again))
        assert g.base_failed == (len(ws) < 50 or 100 * len(again) > 50 * len(ws)) and not (g.base_failed and g.kept)
    assert quality_rules.measure(empty).count() == 0


def test_line_rules(spark):
    junk = ["home | about | contact | more", "BUY!! NOW!! CHEAP!!", "a### b$$$ c%%% d***", "All rights reserved 2020", "We use cookies"]
    body = [text_of("en", 16, 500 + i) for i in range(6)]
    df = spark.createDataFrame([(1, "\n".join([*body, *junk])), (2, "\n".join(junk * 20)), (3, "\n".join(body[:3] + [" | ".join("abcdefghij" * 12)]))], "doc_id long, text string")
    got = {r.doc_id: r._rules for r in quality_rules.measure(df).collect()}
    assert got[1].n_lines_removed == len(junk) and got[1].kept and got[1].clean_text == "\n".join(body)
    assert not got[2].kept and not got[3].kept and got[3].n_lines_removed == 1
    assert [r.text for r in quality_rules.clean(df).collect()] == ["\n".join(body)]


def test_repeated_words_of_long_texts(spark, monkeypatch):
    text = "a b c d a b c a b " * 40
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    want = quality_rules.measure(df).first()._rules.n_repeat_words
    monkeypatch.setattr(quality_rules, "INDEX_BITS", 3)
    assert quality_rules.measure(df).first()._rules.n_repeat_words == want == 360


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(t):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, t or ""):
            d = re.sub("[^0-9]", "", m.group())
            luhn = sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 16 <= len(d) <= 19 and luhn, "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def test_pii_base(spark, docs, rows, empty):
    r = random.Random(6)
    pieces = ["a@b.c", "a@b", "@", "x.y+z@mail-1.example.com", "_d@e.f", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "007.1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111111111111111", "+1 (743) 555-3824", "+12", "+1234567890123456", "é", "😀", " ", ".", "-", "word", "9"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randrange(1, 25))) for _ in range(300)] + ["1" * 50_000, "a." * 20_000, "a@" * 9000, "1." * 9000, "+1" * 9000, None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {g.doc_id: [(s.kind, s.start, s.end) for s in g.base] for g in pii.find(df).collect()}
    assert got == {i: base_spans(t) for i, t in enumerate(texts)}
    assert pii.find(docs).count() == len(rows) and pii.find(empty).count() == 0


def test_pii_query(spark, tmp_path):
    r = random.Random(10)
    pieces = ["a@b.c", "1.2.3.4", "4111 1111 1111 1111", "+1 (743) 555-3824", "é😀", "word", "9", "x@y"]
    texts = [" ".join(r.choice(pieces) for _ in range(r.randrange(1, 12))) for _ in range(80)] + [None, "", "no data"]
    texts += [f"please call me +1 743 555-38{i:02d} now" for i in range(20)] + ["please call me 555 123 4567 now"] * 2
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (3, texts[3])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = pii.query(spark, str(tmp_path))
    assert out.columns[:7] == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    got = out.collect()
    assert len(got) == len(rows)
    listed = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    by = {}
    for g in got:
        by.setdefault(g.doc_id, []).append(g)
    for i, t in rows:
        base = base_spans(t)
        for g in by[i]:
            assert (g.n_email, g.n_ip, g.n_card, g.n_phone) == tuple(sum(k == kind for k, _, _ in base) for kind in pii.KINDS)
            assert g.base_sha256 == hashlib.sha256(listed(base).encode()).hexdigest()
            spans = [x.split(":") for x in g.spans.split(",") if x]
            order = [(pii.KINDS.index(k), int(a), int(b)) for k, a, b in spans]
            assert order == sorted(order) and len(order) == len(base) + g.n_added and set(listed(base).split(",")) - {""} <= set(g.spans.split(","))
    found = [g for g in got if g.doc_id is not None and texts[g.doc_id] == "please call me 555 123 4567 now"]
    assert [g.spans for g in found] == ["phone:15:27"] * 2


def test_pii_finds_by_context(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    fill = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, f"{fill(9)} please call me +1 (5{i:02d}) 555-10{i:02d} or {fill(5)}") for i in range(12)]
    rows += [(100 + i, f"{fill(9)} please call me 0044-77{i}-88990{i} or {fill(5)}") for i in range(4)]
    rows += [(200 + i, f"{fill(9)} order number 99887{i}66{i} shipped {fill(5)}") for i in range(6)]
    got = {g.doc_id: g for g in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(len(got[i].base) == 1 and not got[i].added for i in range(12))
    for i in range(4):
        (s,) = got[100 + i].added
        text = dict(rows)[100 + i]
        assert s.kind == "phone" and text[s.start : s.end] == f"0044-77{i}-88990{i}"
    assert not any(got[200 + i].added for i in range(6))


def test_pii_finds_unseen_forms_and_seeds_further_patterns(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    fill = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, f"{fill(5)} please call me +1 (5{i:02d}) 555-10{i:02d} or {fill(5)}") for i in range(20)]
    rows += [(50 + i, f"{fill(5)} please mail me user{i}@example.com or {fill(5)}") for i in range(20)]
    rows += [(80 + i, f"{fill(5)} the host is 10.1.2.{i} and {fill(5)}") for i in range(20)]
    found = {"phone": ("please call me", ["555 123 4567", "(555) 123-4568", "555.123.4569", "555-123-4560"]), "email": ("please mail me", ["jane.doe@intranet"]), "ip": ("the host is", ["10.0.0.x"])}
    want = {}
    for kind, (lead, forms) in found.items():
        for form in forms:
            want[100 + len(want)] = (kind, form, f"{fill(5)} {lead} {form} {'and' if kind == 'ip' else 'or'} {fill(5)}")
    for form in [*found["phone"][1], "777 88 99"]:  # no base entity stands here
        want[100 + len(want)] = ("phone", form, f"{fill(5)} after hours ring {form} {fill(5)}")
    rows += [(i, t) for i, (_, _, t) in want.items()]
    rows += [(200 + i, f"{fill(9)} order number 99887{i}66{i} shipped {fill(5)}") for i in range(6)]
    got = {g.doc_id: g for g in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: [(s.kind, t[s.start : s.end]) for s in got[i].added] for i, (_, _, t) in want.items()} == {i: [(k, f)] for i, (k, f, _) in want.items()}
    assert not any(got[i].added for i in (*range(100), *range(200, 206)) if i in got)


def test_url_filter(spark):
    entries = [("bad.com", "block", "2024-01-10"), ("bad.com", "remove", "2024-02-10"), ("ok.bad.com", "allow", "2024-01-01"), ("bad.com", "block", "2024-01-10"), ("two.org", "allow", "2024-03-01"), ("two.org", "block", "2024-03-01"), (None, "block", "2024-01-01"), ("x.com", None, "2024-01-01")]
    rows = [(1, "http://bad.com/a", "2024-01-09"), (2, "http://www.BAD.com:80/a", "2024-01-10"), (3, "https://u@ok.bad.com/", "2024-01-20"), (4, "http://bad.com", "2024-02-10"), (5, "http://two.org.", "2025-03-01"), (6, None, "2024-01-20"), (7, "http://bad.com", None), (8, "nonsense", "2024-01-20"), (2, "http://www.BAD.com:80/a", "2024-01-10"), (9, "http://notbad.com", "2024-01-20")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, at string, verdict string")
    out = url_filter.judge(pages, spark.createDataFrame(entries, "list_key string, action string, effective string"), F.col("at"))
    got = sorted((g.page_id, g["_verdict"], g.list_key) for g in out.collect())
    assert got == [(1, "allow", None), (2, "block", "bad.com"), (2, "block", "bad.com"), (3, "allow", "ok.bad.com"), (4, "allow", None), (5, "block", "two.org"), (6, "allow", None), (7, "allow", None), (8, "allow", None), (9, "allow", None)]
    assert {g["_verdict"] for g in url_filter.judge(pages, spark.createDataFrame([], "list_key string, action string, effective string"), F.col("at")).collect()} == {"allow"}


def test_url_filter_against_brute_force(spark):
    r = random.Random(11)
    day = lambda: f"20{r.randrange(20, 99)}-{r.randrange(1, 13):02d}-{r.randrange(1, 28):02d}"
    names = ["com", "a.com", "b.a.com", "c.b.a.com", "d.org", "[2001:db8::1]"]
    entries = [(r.choice(names), r.choice(["block", "allow", "remove"]), day()) for _ in range(60)]
    rows = [(i, f"http://{r.choice(names + ['x.a.com', 'e.org'])}:8080/{'p' * r.choice([0, 5])}", f"{day()} 23:59:59") for i in range(400)]
    rows += [(1000, "http://a.com/" + "q" * 300_000, day()), (1001, "http://" + "y." * 3000 + "a.com", day())]
    want = {}
    for i, url, at in rows:
        host = re.match(r"http://(\[[^]]*\]|[^:/]*)", url)[1]
        parents = [host] + [host.split(".", k)[-1] for k in range(1, host.count(".") + 1)]
        verdict = ("allow", None)
        for k in sorted(set(parents), key=len, reverse=True):
            past = sorted((e[2], {"block": 2, "allow": 1, "remove": 0}[e[1]], e[1]) for e in entries if e[0] == k and e[2] <= at[:10])
            if past and past[-1][2] != "remove":
                verdict = (past[-1][2], k)
                break
        want[i] = verdict
    clash = "verdict list_key _found_h _found_d _found_b host k d h".split()
    pages = spark.createDataFrame([(*x, *clash) for x in rows], "page_id long, url string, at string, " + ", ".join(f"{c} string" for c in clash))
    out = url_filter.judge(pages, spark.createDataFrame(entries, "list_key string, action string, effective string"), F.to_timestamp("at"))
    got = out.collect()
    assert {g.page_id: (g["_verdict"], g["_list_key"]) for g in got} == want and {tuple(g[c] for c in clash) for g in got} == {tuple(clash)}
    none = spark.createDataFrame([], pages.schema)
    assert url_filter.judge(none, spark.createDataFrame(entries, "list_key string, action string, effective string"), F.col("at")).count() == 0


def test_url_filter_holds_in_far_years(spark):
    entries = spark.createDataFrame([("a.com", "block", "2024-01-01"), ("b.com", "block", "2150-01-01"), ("c.com", "block", "2400-01-01")], "list_key string, action string, effective string")
    pages = spark.createDataFrame([("http://a.com", "2101-05-05"), ("http://b.com", "2150-06-01"), ("http://b.com", "2149-12-31"), ("http://c.com", "2300-01-01")], "url string, at string")
    got = {(g.host, str(g.fetch_date)): g.verdict for g in url_filter.judge(pages, entries, F.col("at")).collect()}
    assert got == {("a.com", "2101-05-05"): "block", ("b.com", "2150-06-01"): "block", ("b.com", "2149-12-31"): "allow", ("c.com", "2300-01-01"): "allow"}


HTML = "<!DOCTYPE html><html><head><title>T &amp; U</title><style>p{x}</style><script>var a='</p>';</script></head><body><!-- no --><p>One <b>two</b> 3 &lt; 4<br>five</p><div>é</div><p>unclosed <script>evil"


def test_plain_text():
    assert warc.plain_text(HTML) == "T & U\nOne two 3 < 4\nfive\né\nunclosed"
    assert warc.plain_text("") == "" and len(warc.plain_text("<" * 100_000)) == 100_000 and warc.plain_text("<!--" * 50_000) == ""


def read_warc(data):
    """Records by the letter of the standard: a line at a time, blocks by their length."""
    stream, out = io.BytesIO(gzip.GzipFile(fileobj=io.BytesIO(data)).read()), []
    while (line := stream.readline()):
        assert line == b"WARC/1.1\r\n"
        headers = {}
        while (line := stream.readline()) != b"\r\n":
            k, v = line.decode().rstrip("\r\n").split(":", 1)
            headers[k.lower()] = v.strip()
        out.append((headers, stream.read(int(headers["content-length"]))))
        assert stream.read(4) == b"\r\n\r\n"
    return out


def sha1_32(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_warc_round_trip(spark):
    latin = b"<meta charset='latin-1'><p>caf\xe9</p>"
    rows = [
        ("r1", "<urn:uuid:1>", "http://a/é", "2024-01-01T00:00:00Z", {"Server": "x", "Content-Type": None}, HTML.encode()), (None, None, None, None, None, None),
        ("r1", "<urn:uuid:1>", "http://a/é", "2024-01-01T00:00:00Z", {"Server": "x"}, HTML.encode()), ("r2", "<urn:uuid:2>", "u", "d", {"A": "one\r\nWARC-Type: evil"}, b"\xff\xfe\x63\x61\x66\xe9"),
        ("r3", "<urn:uuid:3>", "u", "d", {}, latin), ("r4", "<urn:uuid:4>", "u", "d", {"content-type": "text/html; charset=utf-16-le"}, "<p>é</p>".encode("utf-16-le")),
        ("r5", "<urn:uuid:5>", "u", "d", {"Content-Type": "text/html; charset=none-such"}, "<p>é</p>".encode()), ("r6", "<urn:uuid:6>", "u", "d", {}, b"<p>word</p>" * 300_000),
    ]
    schema = "source_id string, rid string, uri string, at string, headers map<string,string>, body binary, record_id string, block string"
    df = spark.createDataFrame([(*x, "clash", "clash") for x in rows], schema)
    cols = {"source_id": F.col("source_id"), "uri": F.col("uri"), "date": F.col("at"), "headers": F.col("headers"), "payload": F.col("body"), "response_id": F.col("rid")}
    records = warc.derivatives(df, **cols)
    got = records.collect()
    assert len(got) == 16 and sorted(g.warc_type for g in got) == ["conversion"] * 8 + ["metadata"] * 8
    data = b"".join(bytes(r.warc) for r in warc.to_bytes(records).collect())
    read = read_warc(data)
    assert len(read) == 16 and [({k.lower(): v for k, v in h}, b) for h, b in warc.parse(data)] == read
    body_of, blocks = {x[1]: x[5] for x in rows}, {}
    for headers, block in read:
        assert headers["warc-block-digest"] == sha1_32(block) and headers["warc-type"] in ("metadata", "conversion")
        blocks[headers["warc-refers-to"], headers["warc-type"]] = (headers, block)
        if headers["warc-refers-to"] in body_of:
            assert headers["warc-source-payload-digest"] == sha1_32(body_of[headers["warc-refers-to"]])
    for rid in ("<urn:uuid:1>", "<urn:uuid:2>", "<urn:uuid:3>"):
        about, fields = blocks[rid, "metadata"][0], blocks[rid, "metadata"][1].decode()
        assert about["warc-concurrent-to"] == rid and "warc-concurrent-to" not in blocks[rid, "conversion"][0]
        assert f"conversion-record-id: {blocks[rid, 'conversion'][0]['warc-record-id']}\r\n" in fields
        assert f"source-payload-digest: {sha1_32(body_of[rid])}\r\nsource-payload-length: {len(body_of[rid])}\r\n" in fields
    assert "source-header: A: one WARC-Type: evil\r\n" in blocks["<urn:uuid:2>", "metadata"][1].decode()
    text = {rid: block.decode() for (rid, kind), (_, block) in blocks.items() if kind == "conversion"}
    assert text["<urn:uuid:1>"] == "T & U\nOne two 3 < 4\nfive\né\nunclosed" and text["<urn:uuid:2>"] == "\ufffd\ufffdcaf\ufffd"
    assert text["<urn:uuid:3>"] == "café" and text["<urn:uuid:4>"] == text["<urn:uuid:5>"] == "é" and text["<urn:uuid:6>"].count("word") == 300_000
    assert warc.derivatives(df.limit(0), **cols).count() == 0
    assert warc.parse(b"WARC/1.0\r\nContent-Length:3\r\n\r\nabc\r\n\r\n") == [([("Content-Length", "3")], b"abc")]
    texts = warc.derivatives(df.withColumn("body", F.col("body").cast("string")).filter("source_id = 'r1'"), **cols).collect()
    assert {g.source_payload_digest for g in texts} == {sha1_32(HTML.encode())}
