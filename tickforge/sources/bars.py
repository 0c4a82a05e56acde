"""Bars from event and trade tables, files, and a seeded generator."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("ts", T.TimestampType())] + [T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")])


def from_ticks(df: DataFrame, key: str, ts: str, price: str, unit: str, tie: list[str] | None = None, volume: str | None = None) -> DataFrame:
    """Bars by key and period. Equal times are told apart by `tie`; volume counts ticks if none is named. One
    aggregate with partial sums: a key with most ticks costs its periods, not its rows."""
    at = F.struct(ts, *(tie or []))
    return df.groupBy(F.col(key).cast("string").alias("symbol"), F.date_trunc(unit, F.col(ts)).alias("ts")).agg(
        F.min_by(price, at).cast("double").alias("open"), F.max(price).cast("double").alias("high"), F.min(price).cast("double").alias("low"), F.max_by(price, at).cast("double").alias("close"),
        (F.count(F.lit(1)) if volume is None else F.sum(volume)).cast("double").alias("volume"),
    )


def stream_bars(ticks: DataFrame, key: str, ts: str, price: str, period: str, delay: str, tie: list[str] | None = None, volume: str | None = None) -> DataFrame:
    """Bars of a stream of ticks, each given once: when the watermark, the greatest time less `delay`, has passed its
    period ("1 hour"). Later ticks of that period are dropped, as Spark counts (numRowsDroppedByWatermark)."""
    at = F.struct(ts, *(tie or []))
    windowed = ticks.withWatermark(ts, delay).groupBy(F.col(key).cast("string").alias("symbol"), F.window(ts, period).alias("w"))
    bars = windowed.agg(
        F.min_by(price, at).cast("double").alias("open"), F.max(price).cast("double").alias("high"), F.min(price).cast("double").alias("low"),
        F.max_by(price, at).cast("double").alias("close"), (F.count(F.lit(1)) if volume is None else F.sum(volume)).cast("double").alias("volume"),
    )
    return bars.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def events_bars(spark: SparkSession, sf_dir: str, unit: str = "hour") -> DataFrame:
    return from_ticks(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_type", "ts", "value", unit, ["event_id"])


EVENTS_SQL = """SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close,
  CAST(count(*) AS DOUBLE) AS volume, CAST(epoch(date_trunc('hour', ts)) AS DOUBLE) AS in__ts FROM events GROUP BY ALL"""


def lineitem_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("price", F.try_divide("l_extendedprice", "l_quantity"))
    return from_ticks(li, "l_returnflag", "l_shipdate", "price", "day", ["l_orderkey", "l_linenumber"], "l_quantity")


LINEITEM_SQL = """SELECT l_returnflag AS symbol, date_trunc('day', l_shipdate) AS ts, arg_min(p, (l_shipdate, l_orderkey, l_linenumber)) AS open, max(p) AS high, min(p) AS low, arg_max(p, (l_shipdate, l_orderkey, l_linenumber)) AS close,
  CAST(sum(l_quantity) AS DOUBLE) AS volume FROM (SELECT *, l_extendedprice / nullif(l_quantity, 0) AS p FROM lineitem) GROUP BY ALL"""


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).csv(path, header=True)


def generate(spark: SparkSession, rows: int, seed: int = 7, symbols: int = 1) -> DataFrame:
    """Random-walk minute bars, the same for a seed whatever the partitioning: steps are hashes of their numbers."""
    u = lambda n: (F.pmod(F.xxhash64("symbol", "i", F.lit(seed * 16 + n)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    normal = lambda n: F.sqrt(-2 * F.log(u(n))) * F.cos(2 * 3.141592653589793 * u(n + 1))
    from pyspark.sql import Window

    base = spark.range(rows * symbols).select((F.col("id") % symbols).cast("string").alias("symbol"), F.floor(F.col("id") / symbols).alias("i"))
    walk = F.sum("step").over(Window.partitionBy("symbol").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    base = base.withColumn("step", normal(0)).withColumn("walk", 100 + walk).withColumns({"open": F.col("walk") + 0.2 * normal(2), "close": F.col("walk") + 0.2 * normal(4)})
    return base.select(
        "symbol", F.timestamp_seconds(F.lit(1735689600) + 60 * F.col("i")).alias("ts"), "open", (F.greatest("open", "close") + 0.5 * u(6)).alias("high"), (F.least("open", "close") - 0.5 * u(7)).alias("low"), "close",
        F.floor(100 + 900 * u(8)).cast("double").alias("volume"),
    )
