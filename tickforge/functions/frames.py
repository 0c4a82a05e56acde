"""Frame utilities over bars: resampling, rebasing, to-date filters, times, comparison."""

import time
from datetime import datetime
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def resample(df: DataFrame, keys: list[str], ts: str, unit: str) -> DataFrame:
    """Bars of a longer period: first open, highest high, lowest low, last close, summed volume."""
    return df.groupBy(*keys, F.date_trunc(unit, F.col(ts)).alias(ts)).agg(
        F.min_by("open", ts).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", ts).alias("close"), F.sum("volume").alias("volume")
    )


def constants(df: DataFrame, values: list[float], append: bool = True) -> DataFrame:
    return df.withColumns({str(v): F.lit(float(v)) for v in values}) if append else df.drop(*[str(v) for v in values])


def baseline(df: DataFrame, keys: list[str], order: list[str], columns: list[str], index: int = 0, k: float = 1.0, zero: bool = False, to_log: bool = False) -> DataFrame:
    """Columns in units of their value at row `index` of the series, times k; from zero and in logarithms if wanted."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = {}
    for c in columns:
        x = k * F.try_divide(F.col(c), F.nth_value(c, index + 1).over(w))
        x = F.when(x > 0, F.log(x)) if to_log else x - k if zero else x
        out[c] = x
    return df.withColumns(out)


def to_date(df: DataFrame, ts: str, unit: str, now: Column | None = None) -> DataFrame:
    """Rows since the start of the present month, quarter or year."""
    return df.filter(F.col(ts) >= F.date_trunc(unit, F.current_timestamp() if now is None else now))


def on_dates(df: DataFrame, ts: str, dates: list[str]) -> DataFrame:
    return df.filter(F.to_date(ts).isin([F.lit(d).cast("date") for d in dates])) if dates else df.limit(0)


def total_time(df: DataFrame, keys: list[str], ts: str, unit_seconds: float = 86400.0 * 365.25) -> DataFrame:
    span = F.unix_micros(F.max(ts)) - F.unix_micros(F.min(ts))
    return df.groupBy(*keys).agg((span / 1e6 / unit_seconds).alias("total_time"))


def ordered(df: DataFrame, keys: list[str], ts: str, row: str = "_row") -> DataFrame:
    """Whether each series' times, in the order of a row number column, rise."""
    w = Window.partitionBy(*keys).orderBy(row)
    rises = df.select(*keys, (F.col(ts) > F.lag(ts).over(w)).alias("_up"))
    return rises.groupBy(*keys).agg(F.coalesce(F.bool_and("_up"), F.lit(True)).alias("ordered"))


def reverse(df: DataFrame, order: list[str]) -> DataFrame:
    """The rows from the last to the first."""
    return df.orderBy(*[F.col(c).desc() for c in order])


def simplify_columns(df: DataFrame, n: int = 3) -> list[str]:
    """The n-th letter of each column's name up to its first underscore, in lower case."""
    return [c.lower().split("_")[0][n - 1 : n] for c in df.columns]


def final_time(began: float) -> str:
    """How long it is since a time.perf_counter(), in words."""
    took = time.perf_counter() - began
    return f"{took * 1000:2.4f} ms ({took:2.4f} s)"


#: Time zones of exchanges.
EXCHANGES = {
    "ASX": "Australia/Sydney", "BMF": "America/Sao_Paulo", "GER": "Europe/Berlin", "HKEX": "Asia/Hong_Kong", "JPX": "Asia/Tokyo",
    "LSE": "Europe/London", "NSE": "Asia/Kolkata", "NYSE": "America/New_York", "NZSX": "Pacific/Auckland", "SSE": "Asia/Shanghai", "TSX": "America/Toronto",
}


def get_time(exchange: str = "NYSE", now: datetime | None = None) -> str:
    """The date, the day of the year, and the time at an exchange."""
    there = (now or datetime.now(ZoneInfo("UTC"))).astimezone(ZoneInfo(EXCHANGES[exchange.upper()]))
    day = there.timetuple().tm_yday
    return f"{there:%A %B} {there.day}, {there.year}, {exchange.upper()}: {there:%H:%M:%S}, day {day}/365 ({100 * day / 365:.2f}%)"


def geometric_mean(x: Column) -> Column:
    """The n-th root of the product, as an aggregate. Any zero shifts all values by one and the result back; other
    values that are not positive give 0."""
    zeros = F.max((x == 0).cast("int")) == 1
    shifted = F.exp(F.avg(F.log1p(F.coalesce(x, F.lit(0.0))))) - 1
    # Nulls count among the n, as factors of one.
    plain = F.exp(F.sum(F.log(x)) / F.count(F.lit(1)))
    return F.when(zeros, F.when(F.min(x) > -1, shifted).otherwise(0.0)).when(F.min(x) > 0, plain).otherwise(0.0)


def log_geometric_mean(x: Column) -> Column:
    """The geometric mean of 1 + x less one, as an aggregate; 0 for one value or values of -1 or less."""
    y = F.coalesce(x, F.lit(0.0))
    return F.when((F.count(F.lit(1)) > 1) & (F.min(y) > -1), F.exp(F.avg(F.log1p(F.when(y > -1, y)))) - 1).otherwise(0.0)


def error_analysis(a: DataFrame, b: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """Two tables of the same series side by side: for each column the rows that both have, the correlation, and the
    greatest, mean and mean relative difference."""
    left = a.select(*on, *[F.col(c).cast("double").alias(f"a_{i}") for i, c in enumerate(columns)])
    right = b.select(*on, *[F.col(c).cast("double").alias(f"b_{i}") for i, c in enumerate(columns)])
    both = left.join(right, on)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"a_{i}").alias("x"), F.col(f"b_{i}").alias("y")) for i, c in enumerate(columns)])
    rows = both.select(F.explode(pairs).alias("p")).select("p.*").filter("x is not null and y is not null")
    gap = F.abs(F.col("x") - F.col("y"))
    return rows.groupBy("column").agg(
        F.count("*").alias("rows"), F.corr("x", "y").alias("correlation"), F.max(gap).alias("max_abs"), F.avg(gap).alias("mean_abs"),
        F.avg(F.try_divide(gap, F.abs("x"))).alias("mean_rel"),
    )


def from_millis(c: Column) -> Column:
    return F.timestamp_millis(c)


def to_utc(c: Column, zone: str) -> Column:
    return F.to_utc_timestamp(c, zone)
