"""SimHash near-duplicates: 64-bit fingerprints linked within a Hamming radius by BK-trees."""

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fresh_names, materialize, same_columns, sifted
from .components import connected_components

SHINGLE_WORDS = 3
RADIUS = 2
#: Fingerprints that a shard's tree is meant to hold, and beyond which a shard is divided again.
TREE = 256
MAX_TREE = 2048
#: Shingles hashed at a time, whatever the length of a text.
CHUNK = 65_536


def fingerprint_of(text: str | None) -> int:
    """SimHash of the whole text as an unsigned integer; zero if it has no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return 0
    if n < SHINGLE_WORDS:
        shingles = [b" ".join(words)]
    else:
        shingles = None
    total = max(1, n - SHINGLE_WORDS + 1)
    ones = np.zeros(64, dtype=np.int64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for at in range(0, total, CHUNK):
        part = shingles or map(join, zip(words[at : at + CHUNK], words[at + 1 : at + CHUNK + 1], words[at + 2 : at + CHUNK + 2], strict=False))
        h = np.fromiter((digest(s, 42) for s in part), dtype=np.uint64)
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = (2 * ones > total).astype(np.uint8)
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def signed_fingerprint(text: str | None) -> int:
    x = fingerprint_of(text)
    return x - (1 << 64) if x >> 63 else x


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = [fingerprint_of(t.as_py()) for t in batch.column(1)]
        fps = pa.array(np.array(values, dtype=np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), fps], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the SimHash of every whole text, as a signed long."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(_fingerprints, "doc_id long, fp long")


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


class BKTree:
    """Distinct integers under Hamming distance. The children of a node are keyed by their distance to it, so a
    search within r follows only the edges keyed from d - r to d + r."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        new = len(self.values)
        self.values.append(value)
        self.children.append({})
        if new:
            at = 0
            while True:
                d = (self.values[at] ^ value).bit_count()
                nxt = self.children[at].get(d)
                if nxt is None:
                    self.children[at][d] = new
                    break
                at = nxt
        return new

    def search(self, value: int, radius: int) -> list[int]:
        found, todo = [], [0] if self.values else []
        values, children = self.values, self.children
        while todo:
            at = todo.pop()
            d = (values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            kids = children[at]
            if len(kids) <= 2 * radius + 1:
                todo.extend(c for k, c in kids.items() if d - radius <= k <= d + radius)
            else:
                todo.extend(kids[k] for k in range(max(d - radius, 0), d + radius + 1) if k in kids)
        return found


def _forest(members: list[int], radius: int) -> list[tuple[int, int]]:
    """Links within radius that span each component among the members: at most one for each member."""
    tree, parent, out = BKTree(), [], []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for value in members:
        near = tree.search(value, radius)
        new = tree.add(value)
        parent.append(new)
        for i in near:
            r, s = root(i), root(new)
            if r != s:
                parent[max(r, s)] = min(r, s)
                out.append((value, tree.values[i]))
    return out


def _links(radius: int):
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(shard: np.ndarray) -> None:
            for a, b in _forest(np.unique(shard).view(np.uint64).tolist(), radius):
                pairs.append((a, b))

        def flush() -> pa.RecordBatch:
            both = np.array(pairs, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            pairs.clear()
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["a", "b"])

        pairs: list[tuple[int, int]] = []
        held, key = [], None
        for batch in batches:
            keys = [np.asarray(batch.column(i)) for i in range(2)]
            fps = np.asarray(batch.column(2))
            if not len(fps):
                continue
            cuts = np.flatnonzero((keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1])) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(fps)]])
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                now = (int(keys[0][s]), int(keys[1][s]))
                if now != key:
                    if held and (len(held) > 1 or len(held[0]) > 1):
                        emit(np.concatenate(held))
                    held, key = [], now
                held.append(fps[s:e])
            if len(pairs) >= 10_000:
                yield flush()
        if held and (len(held) > 1 or len(held[0]) > 1):
            emit(np.concatenate(held))
        yield flush()

    return links


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _finer(mask: int, radius: int, bits: int) -> list[int]:
    """radius + 1 masks, each with `mask` and up to `bits` further bits, no further bit in two of them. Of two
    fingerprints that agree on `mask` and differ in `radius` bits at most, one mask or more sees no difference."""
    free = [b for b in range(64) if not mask >> b & 1]
    parts = [free[p :: radius + 1][:bits] for p in range(radius + 1)]
    return [mask | sum(1 << b for b in part) for part in parts]


def _dealt(keyed: DataFrame, masks: list[int]) -> DataFrame:
    """fp once for each mask, with its value under it: mask, shard, fp."""
    out = keyed.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"))
    return out.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("shard"), "fp")


def _shards(fps: DataFrame, radius: int, tree: int, max_tree: int) -> Iterator[DataFrame]:
    """Tables (mask, shard, fp) of shards of max_tree members at most, so that two fingerprints within the radius are
    in one shard together or more. Those of more members are dealt out again by further bits of their own."""
    n = fps.count()
    bits = min(64 // (radius + 1), max(0, math.ceil(math.log2(max(1, n) / tree))))
    masks = sorted(set(_finer(0, radius, bits)))
    keyed = _dealt(fps, masks)
    # Shards that differ in no more than `radius` bits cannot be divided, nor need they.
    max_tree = max(max_tree, 1 << radius)
    while n > max_tree:
        sizes = keyed.groupBy("mask", "shard").agg(F.count("*").alias("n"))
        large = materialize(sizes.filter(F.col("n") > max_tree).select("mask", "shard"), "large-shards")
        wide = sorted(r["mask"] % (1 << 64) for r in large.select("mask").distinct().collect())  # of at most len(masks)
        if not wide:
            break
        yield keyed.join(large, ["mask", "shard"], "left_anti")
        again = materialize(keyed.join(large, ["mask", "shard"], "left_semi"), "dealt-again")
        parts = [(m, _finer(m, radius, 64)) for m in wide]
        finer = None
        for m, into in parts:
            part = _dealt(again.filter(F.col("mask") == _signed(m)).select("fp"), into)
            finer = part if finer is None else finer.union(part)
        masks = sorted({x for _, into in parts for x in into})
        keyed = finer.distinct()
    yield keyed


def near_links(fps: DataFrame, radius: int = RADIUS, tree: int = TREE, max_tree: int = MAX_TREE) -> DataFrame:
    """fps: distinct fingerprints in a column fp. Returns (a, b), pairs within radius that connect exactly what
    all pairs within radius connect.

    Two fingerprints that differ in `radius` bits agree on one of radius + 1 disjoint sets of bits. Every fingerprint
    goes to a shard for each such set, by its values there; the sets are as long as it takes for shards of about
    `tree` fingerprints. Each shard's BK-tree takes its members one by one, and each is first searched for in the tree
    so far, along the edges from d - radius to d + radius only; what a shard emits is a spanning forest, never all
    pairs. A shard of more than max_tree members is divided again by bits that its members need not share, as often
    as it takes, which loses no pair.

    The trees hold every fingerprint, so they grow with the corpus: they are neither broadcast nor brought to the
    driver, but each is built in the task that its shard's fingerprints are dealt to."""
    if not 0 <= radius < 32:
        raise ValueError("the radius must be under 32")
    links = None
    for shards in _shards(fps, radius, tree, max_tree):
        dealt = shards.repartition("mask", "shard").sortWithinPartitions("mask", "shard", "fp")
        part = dealt.mapInArrow(_links(radius), "a long, b long")
        links = part if links is None else links.union(part)
    return links


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fp (SimHash as a signed long), component_id (the least doc_id reachable over
    links of at most `radius` differing bits, itself included).

    Null text counts as empty; texts without words have fingerprint zero and link to each other. Equal texts have
    equal fingerprints and so one component. A null doc_id keeps its row and counts for no minimum (a component of
    null ids only has a null component_id). Repeated rows stay. Other columns are ignored. An empty table gives no
    rows."""
    rows = materialize(fingerprints(docs), "fingerprints")
    least = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = connected_components(near_links(least.select("fp"), radius))
    linked = roots.join(least.withColumnRenamed("fp", "node"), "node")
    by_root = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    # Only fingerprints with a link need their component looked up; for the others it is the least id of the copies.
    component = roots.join(by_root, "root").select(F.col("node").alias("fp"), "component_id")
    # Written, so that the last join is by its own exchange and a fingerprint with many copies can be split there.
    per_fp = materialize(least.join(component, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "components")
    return rows.join(per_fp, "fp").select("doc_id", "fp", "component_id")


def one_of_each_group(docs: DataFrame, find: Callable[[DataFrame], DataFrame] = near_duplicates, key_of: Callable[[str | None], int] = signed_fingerprint) -> DataFrame:
    """docs without near-duplicates as `find` groups them: of each component the row with the least doc_id stays, with
    all its columns. Rows that repeat that id are cut to one. Components of null ids only keep all their rows; key_of
    gives a text the fp that `find` gives it."""
    found = materialize(find(docs), "near-duplicates")
    n = fresh_names(docs, "_first", "_times", "_row", "_fp")
    first, times, row, fp = (F.col(c) for c in n.values())
    id_ = F.col("doc_id").cast("long")
    kept = found.filter("doc_id = component_id").groupBy(F.col("doc_id").alias(n["_first"])).agg(F.count("*").alias(n["_times"]))
    firsts = materialize(kept, "firsts")
    repeated = firsts.filter(times > 1)
    # Ids of which some row goes. All rows of other ids stay where they are; only the former's need the join.
    going = found.filter("doc_id <> component_id").select("doc_id").union(repeated.select(first))
    maybe, staying = sifted(docs, id_, going)
    out = staying.filter(id_.isNotNull()).union(maybe.join(firsts.filter(times == 1), id_ == first, "left_semi"))
    if not repeated.isEmpty():
        again = docs.withColumn(n["_row"], F.struct(*same_columns(docs))).join(repeated, id_ == first)
        out = out.union(again.groupBy(first).agg(F.first(row).alias(n["_row"])).select(f"{n['_row']}.*"))
    lost = found.filter("doc_id is null and component_id is null")
    if not lost.isEmpty():
        keys = lost.select(F.col("fp").alias(n["_first"])).distinct()
        unnamed = docs.filter(F.col("doc_id").isNull())
        tagged = unnamed.withColumn(n["_fp"], F.pandas_udf(_key_series(key_of), "long")(F.col("text").cast("string")))
        out = out.union(tagged.join(keys, fp == first, "left_semi").select(*same_columns(docs)))
    return out


def _key_series(key_of: Callable[[str | None], int]):
    def keys(texts: pd.Series) -> pd.Series:
        return texts.map(key_of)

    return keys


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")
