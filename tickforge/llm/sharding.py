"""Range sharding by sampled splitters: shards are unions of ranges between quantiles of size-weighted key samples."""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, fresh_names, materialize, same_columns

N_SHARDS = 24
#: Ranges a shard is made of at least, and rows a range holds at most in expectation.
RANGES_PER_SHARD = 64
ROWS_PER_RANGE = 1_000_000
#: Sampled keys for each range; with MAX_RANGES this bounds what the driver gets.
SAMPLES_PER_RANGE = 16
MAX_RANGES = 20_000
#: A range over this many times its due bytes is subdivided, for at most this many rounds.
OVERFULL = 2.0
ROUNDS = 6
_LOWEST = -(2**63)

Key = tuple[int, int]


class Range(NamedTuple):
    """What lies between two splitters; `single` if all its rows share one key."""

    number: int
    size: int
    rows: int
    single: bool


class Piece(NamedTuple):
    """Rows of a range from the `first`-th on, all in one shard, whose slots go on from `slot`."""

    range: int
    first: int
    rows: int
    shard: int
    slot: int


def _size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def _range_of(bounds: list[Key]):
    """The number of bounds at or below a key (id, tie)."""
    ids, ties = np.array([b[0] for b in bounds], dtype=np.int64), np.array([b[1] for b in bounds], dtype=np.int64)

    @F.pandas_udf("int")
    def number(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for key, tie in batches:
            k, t = key.to_numpy(), tie.to_numpy()
            low, high = np.searchsorted(ids, k, "left"), np.searchsorted(ids, k, "right")
            for i in np.flatnonzero(low < high).tolist():
                low[i] += np.searchsorted(ties[low[i] : high[i]], t[i], "right")
            yield pd.Series(low.astype(np.int32))

    return number


def splitters(slim: DataFrame, total: int, n: int, seed: int) -> list[Key]:
    """n - 1 quantile boundaries of the keys by size, from a sample that takes a key with a chance in proportion to
    its size; keys due more than one draw weigh accordingly. slim: key, tie, size (total bytes in all)."""
    step = max(1.0, total / (n * SAMPLES_PER_RANGE))
    # A hash of the key in place of rand(): the same keys whatever the partitioning.
    u = (F.pmod(F.xxhash64("key", "tie", F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    weight = F.greatest(F.col("size").cast("double"), F.lit(step))
    drawn = slim.filter(u * step < F.col("size")).select("key", "tie", weight.alias("w")).collect()
    drawn.sort(key=lambda r: (r.key, r.tie))
    mass, bounds, due = 0.0, [], sum(r.w for r in drawn) / n
    for r in drawn:
        if due and mass > 0 and int(mass / due) < int((mass + r.w) / due):
            bounds.append((r.key, r.tie))
        mass += r.w
        if r.w > due:
            # What alone fills a range and more gets a range of its own.
            bounds.append((r.key, r.tie + 1) if r.tie < 2**63 - 1 else (r.key + 1, _LOWEST))
    return bounds


def _measured(slim: DataFrame, bounds: list[Key]) -> list[Range]:
    """The ranges that hold rows, in order, by exact bytes and rows."""
    held = slim.withColumn("range", _range_of(bounds)("key", "tie")).groupBy("range")
    found = held.agg(F.sum("size").alias("b"), F.sum("rows").alias("n"), (F.count("*") == 1).alias("single")).collect()
    return sorted(Range(r["range"], r.b, r.n, r.single) for r in found)


def ranges(slim: DataFrame, n_shards: int) -> tuple[list[Key], list[Range]]:
    """Splitters and the ranges they make of slim: key, tie, size and rows, one row a key. Overfull ranges are sampled again by themselves
    and subdivided, until none is left but those of a single key or ROUNDS are over."""
    total, rows = slim.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    if not rows:
        return [], []
    n = min(MAX_RANGES, max(n_shards * RANGES_PER_SHARD, rows // ROWS_PER_RANGE))
    bounds = sorted(set(splitters(slim, total, n, 17)))
    due = total / n
    for round_ in range(ROUNDS):
        held = _measured(slim, bounds)
        full = [r for r in held if r.size > OVERFULL * due and not r.single]
        if not full:
            break
        inside = slim.withColumn("range", _range_of(bounds)("key", "tie")).join(
            F.broadcast(slim.sparkSession.createDataFrame([(r.number,) for r in full], "range int")), "range", "left_semi",
        )
        size = sum(r.size for r in full)
        more = splitters(inside, size, min(MAX_RANGES, 4 * int(size / due + 1)), 18 + round_)
        new = sorted(set(bounds) | set(more))
        if len(new) == len(bounds):
            break
        bounds = new
    else:
        held = _measured(slim, bounds)
    return bounds, held


def allot(held: list[Range], n_shards: int) -> list[Piece]:
    """Consecutive ranges to shards: a range goes where the middle of its bytes lies. Rows that share a key are alike,
    so a range of nothing else is dealt out row by row in the same way, as far as it spans shards."""
    total, before, out = sum(r.size for r in held), 0, []
    filled = [0] * n_shards
    for r in held:
        pieces = [(0, r.rows)]
        if r.single and r.rows > 1:
            each = r.size // r.rows
            cuts = [-((before - total * s // n_shards) // each) for s in range(n_shards + 1)]
            cuts = sorted({0, r.rows, *(c for c in cuts if 0 < c < r.rows)})
            pieces = [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]
        for first, rows in pieces:
            middle = 2 * before + r.size * (2 * first + rows) // r.rows
            shard = min(n_shards - 1, middle * n_shards // (2 * total))
            out.append(Piece(r.number, first, rows, shard, filled[shard]))
            filled[shard] += rows
        before += r.size
    return out


def shard(docs: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """docs with columns size, text_crc32, shard and slot (underscored further where docs has such names).

    Law `bytes`. The key is doc_id, then a hash of the whole row. Size-weighted samples give splitters, which cut the
    keys into ranges of about 1 / (RANGES_PER_SHARD * n_shards) of all bytes; overfull ranges are subdivided. A shard
    is a run of consecutive ranges, so shards differ by the bytes of a range or of the largest record, whichever is
    more. slot counts a shard's rows from 0 in key order. Rows with equal texts but other ids lie apart.

    Null text has 0 bytes plus 8 and the checksum of the empty text; a null doc_id sorts first; a doc_id must be a
    whole number. Repeated rows are all kept: if they overfill a range, one of them and their number go through the
    shuffle, and they are dealt out among shards. An empty table gives no rows."""
    text = F.col("text").cast("string")
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST))
    tie = F.xxhash64(*[
        c if f.dataType.typeName() not in ("map", "variant") else F.to_json(c) for c, f in zip(same_columns(docs), docs.schema, strict=True)
    ])
    rows = docs.select(key.alias("key"), tie.alias("tie"), _size(text).alias("size"))
    slim = materialize(rows.groupBy("key", "tie").agg(F.sum("size").alias("size"), F.count("*").alias("rows")), "sizes")
    bounds, held = ranges(slim, n_shards)
    pieces = allot(held, n_shards)
    spark = docs.sparkSession
    name = fresh_names(docs, "size", "text_crc32", "shard", "slot")
    tmp = fresh_names(docs, "_key", "_tie", "_range", "_nth", "_piece", "_first", "_rows", "_slot", "_in")
    wide = docs.withColumns({tmp["_key"]: key, tmp["_tie"]: tie, name["size"]: _size(text), name["text_crc32"]: F.crc32(F.coalesce(text, F.lit("")))})
    wide = wide.withColumn(tmp["_range"], _range_of(bounds)(tmp["_key"], tmp["_tie"]))
    # A row for each piece: MAX_RANGES and their subdivisions at most, made by the driver.
    places = F.broadcast(spark.createDataFrame(pieces, f"`{tmp['_piece']}` int, `{tmp['_first']}` long, `{tmp['_rows']}` long, `{name['shard']}` int, `{tmp['_slot']}` long"))
    on = F.col(tmp["_range"]) == F.col(tmp["_piece"])
    columns = [*same_columns(docs), *[F.col(name[c]) for c in ("size", "text_crc32", "shard", "slot")]]
    due = sum(r.size for r in held) / (n_shards * RANGES_PER_SHARD)
    alike = [r.number for r in held if r.single and r.rows > 1 and r.size > OVERFULL * due]
    in_order = Window.partitionBy(tmp["_range"]).orderBy(tmp["_key"], tmp["_tie"])
    varied = wide if not alike else wide.filter(~F.col(tmp["_range"]).isin(alike))
    placed = varied.withColumn(tmp["_nth"], F.row_number().over(in_order).cast("long") - 1).join(places, on)
    here = F.col(tmp["_nth"]).between(F.col(tmp["_first"]), F.col(tmp["_first"]) + F.col(tmp["_rows"]) - 1)
    slot = F.col(tmp["_slot"]) + F.col(tmp["_nth"]) - F.col(tmp["_first"])
    out = placed.filter(here).withColumn(name["slot"], slot).select(*columns)
    if alike:  # at most one for each 1 / (n_shards * RANGES_PER_SHARD) of the bytes
        row = F.struct(*same_columns(docs), name["size"], name["text_crc32"]).alias(tmp["_in"])
        one = wide.filter(F.col(tmp["_range"]).isin(alike)).groupBy(tmp["_range"]).agg(F.first(row).alias(tmp["_in"]))
        again = one.join(places, on).withColumn(tmp["_nth"], F.explode(F.sequence(F.lit(0).cast("long"), F.col(tmp["_rows"]) - 1)))
        again = again.select(f"{tmp['_in']}.*", name["shard"], (F.col(tmp["_slot"]) + F.col(tmp["_nth"])).alias(name["slot"]))
        out = out.union(again.select(*columns))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
