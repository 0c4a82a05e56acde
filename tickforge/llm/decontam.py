"""Benchmark decontamination by winnowed fingerprints, extended to exact windows of words."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fresh_name, fresh_names, materialize, same_columns

#: Words of a window that must be shared.
WINDOW = 10
#: Words of a k-gram. The least hash of every WINDOW - GRAM + 1 consecutive k-grams is kept, so any WINDOW shared
#: words hold one kept k-gram at least.
GRAM = 5
#: Bytes of benchmark text in one index. More text is divided into blocks, and documents into those that share a
#: fingerprint with the benchmark and those that do not.
BLOCK_BYTES = 4 << 20
#: Bits of the map that tells Python workers which fingerprints the benchmark cannot have, whatever its size.
MAP_BITS = 1 << 26
#: The word pattern, upper case included.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Words handled at a time, whatever the length of a text.
CHUNK = 1 << 18

#: Lower-cases A-Z, keeps a-z, 0-9 and all bytes from 0x80, and makes the rest spaces.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_BASE = 0x9E3779B97F4A7C15


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def _grams(ids: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of n ids; grams with an id of 0 (a word no item has) get the largest value."""
    m = len(ids) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    h, known = np.zeros(m, dtype=np.uint64), np.ones(m, dtype=bool)
    for j in range(n):
        part = ids[j : j + m]
        h = h * np.uint64(_BASE) + part.astype(np.uint64)
        known &= part > 0
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return np.where(known, np.minimum(h, np.uint64(2**64 - 2)), np.uint64(2**64 - 1))


def winnow(h: np.ndarray, size: int) -> np.ndarray:
    """Positions of the least hash (the rightmost of equals) of every `size` consecutive hashes; fewer hashes than
    that are one window."""
    if not len(h):
        return np.zeros(0, dtype=np.int64)
    size = min(size, len(h))
    m = len(h) - size + 1
    best, at = h[:m].copy(), np.arange(m)
    for j in range(1, size):
        part = h[j : j + m]
        less = part <= best
        best = np.where(less, part, best)
        at = np.where(less, np.arange(j, j + m), at)
    return np.unique(at)


class Index:
    """The windows of a bounded block of items. windows[n]: the distinct windows of n words, their hashes sorted
    (n below WINDOW only for items that are shorter), each with the items that have it."""

    def __init__(self, items: list[tuple[str | None, str | None]]) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.items = sorted({i for i, _ in items if i is not None})
        number = {i: k for k, i in enumerate(self.items)}
        found: dict[int, dict[tuple[int, ...], set[int]]] = {}
        prints: set[int] = set()
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            if not ids:
                continue
            n = min(len(ids), WINDOW)
            here = found.setdefault(n, {})
            for at in range(len(ids) - n + 1):
                owners = here.setdefault(tuple(ids[at : at + n]), set())
                if item is not None:
                    owners.add(number[item])
            if n == WINDOW:
                h = _grams(np.array(ids, dtype=np.int32), GRAM)
                prints.update(h[winnow(h, WINDOW - GRAM + 1)].tolist())
        self.prints = np.array(sorted(prints), dtype=np.uint64)
        self.windows = {}
        for n, here in found.items():
            rows = np.array(list(here), dtype=np.int32).reshape(-1, n)
            h = _hash_rows(rows)
            order = np.argsort(h, kind="stable")
            owners = [sorted(o) for o in here.values()]
            self.windows[n] = (h[order], rows[order], [owners[i] for i in order.tolist()])


def _hash_rows(rows: np.ndarray) -> np.ndarray:
    return _grams_at(rows.ravel(), np.arange(len(rows)) * rows.shape[1], rows.shape[1])


def _member(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    if not len(of):
        return np.zeros(len(values), dtype=bool)
    at = np.searchsorted(of, values)
    at[at == len(of)] = 0
    return of[at] == values


def _occurrences(index: Index, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, starts, windows): where windows of n words occur exactly. Winnowed k-grams that the benchmark shares
    name the candidates for full windows; each is extended to every window around it and compared word by word."""
    for n, (hashes, rows, _) in index.windows.items():
        if len(ids) < n:
            continue
        if n == WINDOW:
            h = _grams(ids, GRAM)
            kept = winnow(h, WINDOW - GRAM + 1)
            kept = kept[_member(h[kept], index.prints)]
            if not len(kept):
                continue
            starts = np.unique((kept[:, None] - np.arange(WINDOW - GRAM + 1)[None, :]).ravel())
            starts = starts[(starts >= 0) & (starts <= len(ids) - n)]
            h = _grams_at(ids, starts, n)
        else:
            h = _grams(ids, n)
            starts = np.arange(len(h))
        near = _member(h, hashes)
        starts, h = starts[near], h[near]
        first, last = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
        while len(starts):  # different windows of one hash stand side by side
            same = (rows[first] == ids[starts[:, None] + np.arange(n)[None, :]]).all(axis=1)
            yield n, starts[same], first[same]
            first = first + 1
            more = ~same & (first < last)
            starts, first, last = starts[more], first[more], last[more]


def _grams_at(ids: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    h, known = np.zeros(len(starts), dtype=np.uint64), np.ones(len(starts), dtype=bool)
    for j in range(n):
        part = ids[starts + j]
        h = h * np.uint64(_BASE) + part.astype(np.uint64)
        known &= part > 0
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return np.where(known, np.minimum(h, np.uint64(2**64 - 2)), np.uint64(2**64 - 1))


def scan(index: Index, texts: list[str | None]) -> tuple[list[int], list[np.ndarray], list[list[str]]]:
    """For each text its number of words, the hit words (their positions) and the items with occurring windows."""
    counts, hits, items = [], [[] for _ in texts], [set() for _ in texts]
    get = index.vocabulary.get
    pending: list[tuple[int, int, np.ndarray]] = []  # text, position of its first word, word ids
    size = 0

    def work() -> None:
        nonlocal size
        ids = np.concatenate([p for _, _, part in pending for p in (part, np.zeros(1, dtype=np.int32))])
        ends = np.cumsum([len(part) + 1 for _, _, part in pending])
        for n, starts, windows in _occurrences(index, ids):
            if not len(starts):
                continue
            owner = np.searchsorted(ends, starts, "right")
            owners_of = index.windows[n][2]
            for k in np.unique(owner).tolist():
                mine = owner == k
                text, first, part = pending[k]
                base = first - (int(ends[k]) - len(part) - 1)
                hits[text].append(np.unique((starts[mine][:, None] + base + np.arange(n)[None, :]).ravel()))
                for w in np.unique(windows[mine]).tolist():
                    items[text].update(owners_of[w])
        pending.clear()
        size = 0

    for k, text in enumerate(texts):
        words = words_of(text)
        counts.append(len(words))
        for at in range(0, len(words), CHUNK):
            part = words[at : at + CHUNK + WINDOW - 1]
            pending.append((k, at, np.fromiter((get(w, 0) for w in part), dtype=np.int32, count=len(part))))
            size += len(part)
            if size >= CHUNK:
                work()
    if pending:
        work()
    none = np.zeros(0, dtype=np.int64)
    return counts, [np.unique(np.concatenate(h)) if h else none for h in hits], [sorted(index.items[i] for i in s) for s in items]


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[tuple[int, int, list[tuple[str | None, str | None]]]]:
    """The items in blocks of about block_bytes, one at a time: (number, of how many, items)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    total = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for b in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        yield b, n, [(r.item_id, r.text) for r in part.collect()]


def _leak_udf(index: Index, positions: bool):
    @F.pandas_udf("struct<n_words:long,n_hit:long,hits:array<long>,items:array<string>>")
    def leak(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            counts, hits, found = scan(index, texts.tolist())
            yield pd.DataFrame({"n_words": counts, "n_hit": [len(h) for h in hits], "hits": [h if positions else None for h in hits], "items": found})

    return leak.asNondeterministic()


def prints_of(text: str | None, short: list[int], grams: bool = True) -> np.ndarray:
    """The distinct signed fingerprints of a text: its winnowed k-grams, and all its windows of the lengths in `short`,
    hashed by their words and length."""
    words = words_of(text)
    out = []
    for at in range(0, len(words), CHUNK):
        part = words[at : at + CHUNK + WINDOW - 1]
        ids = np.fromiter(map(xxhash.xxh64_intdigest, part), dtype=np.uint64, count=len(part)) | np.uint64(1)
        if grams:
            h = _grams(ids, GRAM)
            out.append(h[winnow(h, WINDOW - GRAM + 1)])
        out += [_grams(ids, n) ^ np.uint64(n) for n in short]
    return np.unique(np.concatenate(out)).view(np.int64) if out else np.zeros(0, dtype=np.int64)


def _item_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints, lengths = [], []
        for text in batch.column(0):
            n = len(words_of(text.as_py()))
            # An item shorter than a window is one window, found by its own length.
            h = prints_of(text.as_py(), [n] if n < WINDOW else [], grams=n >= WINDOW)
            prints.append(h)
            lengths.append(np.full(len(h), n if n < WINDOW else 0, dtype=np.int32))
        none = [np.zeros(0, dtype=np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(prints or none)), pa.array(np.concatenate(lengths or none), pa.int32())], names=["print", "short"])


def _text_prints(short: list[int], bits):
    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may = bits.value
        for batch in batches:
            found = [prints_of(t.as_py(), short) for t in batch.column(2)]
            found = [h[may[(h.view(np.uint64) % np.uint64(MAP_BITS)).astype(np.int64)]] for h in found]
            at = np.repeat(np.arange(len(found)), [len(h) for h in found])
            prints = pa.array(np.concatenate(found or [np.zeros(0, dtype=np.int64)]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), prints], names=["h", "c", "print"])

    return shared


def _text_key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("h"), F.coalesce(F.crc32(text), F.lit(-1)).alias("c")]


def candidates(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(h, c): the keys of texts that share a fingerprint with the benchmark, by a join of both sides' fingerprints.
    What a map of MAP_BITS bits shows that the benchmark lacks is not dealt out at all. A text that holds a window
    shares one fingerprint at least: a kept k-gram, or the window itself if its item is shorter."""
    spark = docs.sparkSession
    prints = benchmark.select(F.col("text").cast("string")).mapInArrow(_item_prints, "print long, short int")
    prints = materialize(prints.distinct(), "benchmark-prints")
    short = [r.short for r in prints.filter("short > 0").select("short").distinct().collect()]  # of 1 to WINDOW - 1
    bit = F.pmod("print", F.lit(MAP_BITS))  # that of the unsigned print, too
    on = F.expr("bit_or(shiftleft(1L, cast(bit % 32 as int)))").alias("on")
    words = prints.select(bit.alias("bit")).groupBy(F.expr("cast(bit div 32 as int)").alias("at")).agg(on).toPandas()
    packed = np.zeros(MAP_BITS // 32, dtype="<u4")
    packed[words["at"].to_numpy(dtype=np.int64)] = words["on"].to_numpy(dtype=np.uint64).astype("<u4")
    may = spark.sparkContext.broadcast(np.unpackbits(packed.view(np.uint8), bitorder="little").astype(bool))
    text = F.col("text").cast("string")
    shared = docs.filter(text.isNotNull()).select(*_text_key(text), text.alias("text")).mapInArrow(_text_prints(short, may), "h long, c long, print long")
    return materialize(shared.join(prints.select("print").distinct(), "print", "left_semi").select("h", "c").distinct(), "candidates")


def contaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, name: str | None = None) -> DataFrame:
    """docs with a struct column `name` (n_words, n_hit, items; fresh_name(docs, "_leak") unless given): the document's
    words, those inside an occurrence of a benchmark window, and the sorted ids of the items whose windows occur.

    The benchmark's bytes are counted first. Up to block_bytes, one index goes to the workers and one pass over the
    texts finds all. Beyond, one pass joins the fingerprints of texts and items; the texts that share one are written
    to the shared folder, each block of items is sought in these alone, and the hits are united by text, so no more
    than a block is ever on the driver or a worker. Texts are told apart by two checksums of 96 bits in all.

    Null or wordless texts have no words and no hits. Items with a null text or without words have no windows; those
    with a null id hit, but are not listed. Repeated documents or items change nothing for others; other columns pass
    through. Empty documents give no rows, an empty benchmark no hits."""
    name = name or fresh_name(docs, "_leak")
    text = F.col("text").cast("string")
    parts, sought = [], None
    for b, n, items in _blocks(benchmark, block_bytes):
        leak = _leak_udf(Index(items), n > 1)
        if n == 1:
            found = docs.withColumn(name, leak(text))
            return found.withColumn(name, F.struct(f"{name}.n_words", f"{name}.n_hit", f"{name}.items"))
        if b == 0:
            keyed = docs.select(*_text_key(text), text.alias("text")).join(candidates(docs, benchmark), ["h", "c"], "left_semi")
            sought = materialize(keyed.dropDuplicates(["h", "c"]), "candidate-texts")
        part = sought.select("h", "c", leak(F.col("text")).alias("part")).select("h", "c", "part.*").filter("n_hit > 0")
        parts.append(materialize(part.select("h", "c", "hits", "items"), "leaks"))
    some = parts[0]
    for part in parts[1:]:
        some = some.union(part)
    some = some.groupBy("h", "c").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("hits")))).cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    tmp = fresh_names(docs, "_text_h", "_text_c", "_hit_n", "_hit_items")
    h, c, n_hit, found = (F.col(x) for x in tmp.values())
    united = some.select(*[F.col(x).alias(y) for x, y in zip(("h", "c", "n_hit", "items"), tmp.values(), strict=True)])
    of_text = _text_key(text)
    joined = docs.join(united, (of_text[0] == h) & (of_text[1] == c), "left")
    words = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    items = F.coalesce(found, F.array().cast("array<string>"))
    return joined.select(*same_columns(docs), F.struct(words.alias("n_words"), F.coalesce(n_hit, F.lit(0)).alias("n_hit"), items.alias("items")).alias(name))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold a benchmark window."""
    name = fresh_name(docs, "_leak")
    return contaminated(docs, benchmark, name=name).filter(f"{name}.n_hit = 0").select(*same_columns(docs))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "_leak.n_words", "_leak.n_hit",
        F.size("_leak.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "_leak.items"), 256).alias("items_sha256"),
        (F.col("_leak.n_hit") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS s FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT DISTINCT doc_id, dw.n, s, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""
