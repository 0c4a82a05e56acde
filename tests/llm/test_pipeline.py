"""The pipeline's stages, in order and each on its own input, and the queries' columns."""

import random

import corpus_pipeline
import pytest
from tickforge.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontaminate", "mix", "shard"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, columns = {r.doc_id for r in docs.collect()}, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        ids = [r.doc_id for r in docs.collect()]
        assert docs.columns == columns and len(ids) == len(set(ids)) and set(ids) <= before, name
        before = set(ids)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in last.collect()} == before and {"shard", "slot"} <= set(last.columns)
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == before


CLASHES = "_lang score _first _times _row _fp n bands text_key h c _leak _key_source _leaf_epochs copies _key _tie _range size shard slot".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)


def odd_rows():
    def text(i, lang):
        r = random.Random(i)
        return " ".join(f"{'the' if lang == 'en' else 'les'}{r.randrange(1000)}{'ing' if lang == 'en' else 'ez'}" for _ in range(30))

    rows = [(i, text(i, "en" if i % 2 else "fr"), "en" if i % 2 else "fr", f"s{i % 3}", 1) for i in range(40)]
    rows += [(100, None, None, None, None), (101, "", "en", "s1", 0), (102, "1 2 3", None, "s1", 5), (None, text(77, "en"), None, None, None), (None, None, None, None, None)]
    rows += [(103, rows[3][1], "en", None, 1), (4, rows[4][1], "fr", "s1", 1), (4, rows[4][1], "fr", "s1", 1), (104, "word " * 60_000 + "fin", None, "s2", 1)]
    return [(*r, *CLASHES) for r in rows]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, tmp_path, name):
    rows = odd_rows()
    spark.createDataFrame([(1, " ".join(rows[7][1].split()[3:15])), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, stage = spark.createDataFrame(rows, SCHEMA).repartition(4), dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs, str(tmp_path))
    assert out.columns[: len(docs.columns)] == docs.columns and (len(out.columns) > len(docs.columns)) == (name == "shard")
    got = [tuple(r)[: len(docs.columns)] for r in out.collect()]
    count = lambda x: sorted(map(str, x))
    lettered = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    if name == "language_id":
        assert set(count(got)) <= set(count(lettered)) and len(got) >= len(lettered) - 2
    elif name == "near_dedup":
        kept = [(r[0], r[1]) for r in got]
        assert len(kept) == len(set(kept)) and (4, rows[4][1]) in kept and 103 not in {i for i, _ in kept}
        assert {t for _, t in kept if t and len(t.split()) > 3} == {r[1] for r in rows if r[1] and len(r[1].split()) > 3}
        assert sum(not t for _, t in kept) == 1
    elif name == "decontaminate":
        assert count(got) == count(r for r in rows if r[0] != 7)
    elif name == "mix":
        assert set(count(got)) <= set(count(rows)) and 0 < len(got) < len(rows)
    else:
        assert count(got) == count(rows)
        slots = {}
        for r in out.collect():
            slots.setdefault(r["_shard"], []).append(r["_slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    none = stage(spark, docs.limit(0), str(tmp_path))
    assert none.columns == out.columns and none.count() == 0


@pytest.mark.parametrize("n", range(1, 11))
def test_one_query_for_each_operator(spark, n):
    (name,) = [q for q in QUERIES if q.startswith(f"op{n}_")]
    assert QUERIES[name](spark, SF).count() > 0
    assert set(ORACLES) <= set(QUERIES)
