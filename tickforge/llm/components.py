"""Connected components by alternating large-star and small-star steps."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (a, b) with a > b. Minima come from a grouped aggregate, which combines before the
    shuffle, and go back by a join; no neighbour list is ever gathered."""
    if large:
        pairs = edges.union(edges.select(F.col("b"), F.col("a"))).toDF("u", "v")
    else:
        pairs = edges.toDF("u", "v")
    least = pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    joined = pairs.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
    return out.filter("a > b").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges: two columns of longs, any order or repetition. Returns (node, root): every node of an edge with the
    least node of its component. Each round is written to the shared folder, so lineage stays short; the rounds
    grow with the logarithm of the longest path. No edges give no rows."""
    a, b = edges.columns
    now = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a > b").distinct()
    now = materialize(now, "edges")
    seen = None
    for _ in range(max_rounds):
        now = materialize(_stars(_stars(now, large=True), large=False), "stars")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
