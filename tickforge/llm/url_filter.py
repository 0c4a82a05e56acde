"""Temporal URL filters: dated list entries become validity intervals, and every capture is judged by the entries
active when it was fetched. DataFrame functions only."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_names, materialize, same_columns

#: The end of an interval that no later entry closes.
OPEN_END = "9999-12-31"
FIRST_FETCH = "2024-01-01"
FETCH_DAYS = 366
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[0-9A-Fa-f:.]+\]|[^/?#:@]*)"


def host_of(url: Column) -> Column:
    """The lower-case host, without user, port or a trailing dot; an IPv6 host in its brackets; null if there is none."""
    host = F.regexp_extract(url, HOST, 1)
    host = F.regexp_replace(F.lower(host), r"[.]+$", "")
    return F.when(host != "", host)


def intervals(entries: DataFrame) -> DataFrame:
    """entries: list_key (a host or parent domain), action (`block`, `allow` or `remove`), effective (date). Returns
    (list_key, action, valid_from, valid_to): each entry holds from its day until the key's next one; a removal only
    ends. Of several entries on one day the strictest holds: block, then allow, then remove. Rows with nulls say
    nothing, and repeated rows nothing more."""
    strict = F.when(F.col("action") == "block", 2).when(F.col("action") == "allow", 1).when(F.col("action") == "remove", 0)
    known = entries.select(F.lower("list_key").alias("list_key"), strict.alias("_s"), F.col("effective").cast("date").alias("valid_from"))
    daily = known.na.drop().groupBy("list_key", "valid_from").agg(F.max("_s").alias("_s"))
    # Grouped by key and day first; a key's history is one row a day at most.
    later = F.lead("valid_from").over(Window.partitionBy("list_key").orderBy("valid_from"))
    out = daily.withColumn("valid_to", F.coalesce(later, F.lit(OPEN_END).cast("date"))).filter("_s > 0")
    return out.select("list_key", F.when(F.col("_s") == 2, "block").otherwise("allow").alias("action"), "valid_from", "valid_to")


def as_of(captures: DataFrame, valid: DataFrame) -> DataFrame:
    """captures: k, d (distinct keys and days); valid: intervals. Returns (k, d, action, valid_from): for each capture
    the interval of its key that holds on its day, if there is one.

    One pass in time order over the union of both: a capture takes the last interval that began by its day, and drops
    it if that has ended. A key has a row a day and a row an interval, however many captures it has."""
    begun = F.struct("action", "valid_from", "valid_to")
    events = valid.select(F.col("list_key").alias("k"), F.col("valid_from").alias("d"), F.lit(0).alias("turn"), begun.alias("interval"))
    asked = captures.select("k", "d", F.lit(1).alias("turn"), F.lit(None).cast(events.schema["interval"].dataType).alias("interval"))
    so_far = Window.partitionBy("k").orderBy("d", "turn").rowsBetween(Window.unboundedPreceding, 0)
    met = events.union(asked).withColumn("interval", F.last("interval", ignorenulls=True).over(so_far))
    return met.filter("turn = 1 and d < interval.valid_to").select("k", "d", "interval.action", "interval.valid_from")


def judge(pages: DataFrame, entries: DataFrame, fetched: Column) -> DataFrame:
    """pages with columns host, fetch_date, verdict, list_key and valid_from (by fresh_name): the active entry of the
    longest key among a capture's host and its parent domains decides, and without one the verdict is `allow`.

    Entries have dates, so the day of a fetch says as much as its time. Captures are first reduced to distinct hosts
    and days, so a host with a third of all captures is a few hundred rows; of its parent domains only listed ones go
    on, and meet their intervals as of the day. A capture without host or fetch time matches nothing and is allowed.
    Repeated rows and other columns pass through; an empty table gives no rows, an empty list allows all."""
    n = fresh_names(pages, "host", "fetch_date", "verdict", "list_key", "valid_from")
    found = fresh_names(pages, "_found_h", "_found_d", "_found_b")
    tagged = pages.withColumns({n["host"]: host_of(F.col("url").cast("string")), n["fetch_date"]: fetched.cast("date")})
    seen = tagged.select(F.col(n["host"]).alias("h"), F.col(n["fetch_date"]).alias("d")).na.drop().distinct()
    labels = F.split("h", "[.]")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    # All three are written: each is read twice, and hosts meet their verdicts by key and day, so that a listed domain
    # with most hosts is not one task.
    valid = materialize(intervals(entries), "intervals")
    listed = valid.select(F.col("list_key").alias("k")).distinct()
    keyed = materialize(seen.select("h", "d", F.explode(suffixes).alias("k")).join(listed, "k", "left_semi"), "listed-hosts")
    held = materialize(as_of(keyed.select("k", "d").distinct(), valid), "as-of")
    active = keyed.join(held, ["k", "d"])
    best = active.groupBy("h", "d").agg(F.max(F.struct(F.length("k").alias("l"), F.col("k"), F.col("valid_from"), F.col("action"))).alias("b"))
    best = best.select(F.col("h").alias(found["_found_h"]), F.col("d").alias(found["_found_d"]), F.col("b").alias(found["_found_b"]))
    on = (F.col(n["host"]) == F.col(found["_found_h"])) & (F.col(n["fetch_date"]) == F.col(found["_found_d"]))
    b = F.col(found["_found_b"])
    return tagged.join(best, on, "left").select(
        *same_columns(pages), n["host"], n["fetch_date"], F.coalesce(b["action"], F.lit("allow")).alias(n["verdict"]),
        b["k"].alias(n["list_key"]), b["valid_from"].alias(n["valid_from"]),
    )


def fetch_date(page_id: Column) -> Column:
    """The tables have no fetch times: captures are dealt over FETCH_DAYS days by their id."""
    return F.date_add(F.lit(FIRST_FETCH).cast("date"), F.pmod(page_id.cast("long"), F.lit(FETCH_DAYS)).cast("int"))


def list_from(pages: DataFrame) -> DataFrame:
    """The tables have no list: the first hexadecimal digits of a host's checksum deal it blocks, removals and
    allowances with dates over the year, and the registered domains a block of two months each."""
    hosts = pages.select(host_of(F.col("url").cast("string")).alias("h")).na.drop().distinct().withColumn("m", F.md5("h"))
    digit = lambda c, i: F.conv(F.substring(c, i, 2), 16, 10).cast("int")
    day = lambda c, i, m: F.date_add(F.lit(FIRST_FETCH).cast("date"), F.pmod(digit(c, i), F.lit(m)))
    hosts = hosts.withColumn("domain", F.substring_index("h", ".", -2))
    own = hosts.filter(digit("m", 1) < 128)
    domains = hosts.select("domain").distinct().withColumn("m", F.md5("domain"))
    rows = [
        own.select("h", F.lit("block"), day("m", 3, 100)), own.filter(digit("m", 1) < 80).select("h", F.lit("remove"), F.date_add(day("m", 5, 100), 120)),
        own.filter(digit("m", 1) < 40).select("h", F.lit("allow"), F.date_add(day("m", 7, 100), 240)),
        domains.select("domain", F.lit("block"), day("m", 3, 250)), domains.select("domain", F.lit("remove"), F.date_add(day("m", 3, 250), 60)),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out.toDF("list_key", "action", "effective")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, list_from(pages), fetch_date(F.col("page_id"))).select("page_id", "host", "fetch_date", "verdict", "list_key", "valid_from")


_HOST = f"nullif(regexp_replace(lower(regexp_extract(url, '{HOST}', 1)), '[.]+$', ''), '')"
ORACLE = f"""
WITH p AS (SELECT page_id, {_HOST} AS host, DATE '2024-01-01' + CAST(((page_id % 366) + 366) % 366 AS INTEGER) AS fetch_date FROM pages),
hs AS (SELECT DISTINCT host AS h, md5(host) AS m, array_to_string(string_split(host, '.')[-2:], '.') AS dom FROM p WHERE host IS NOT NULL),
hd AS (SELECT *, CAST('0x' || substr(m, 1, 2) AS INTEGER) AS d1, CAST('0x' || substr(m, 3, 2) AS INTEGER) % 100 AS d3, CAST('0x' || substr(m, 5, 2) AS INTEGER) % 100 AS d5, CAST('0x' || substr(m, 7, 2) AS INTEGER) % 100 AS d7 FROM hs),
dm AS (SELECT DISTINCT dom, CAST('0x' || substr(md5(dom), 3, 2) AS INTEGER) % 250 AS d3 FROM hs),
e AS (SELECT h AS k, 2 AS s, DATE '2024-01-01' + d3 AS f FROM hd WHERE d1 < 128 UNION ALL SELECT h, 0, DATE '2024-01-01' + d5 + 120 FROM hd WHERE d1 < 80
  UNION ALL SELECT h, 1, DATE '2024-01-01' + d7 + 240 FROM hd WHERE d1 < 40 UNION ALL SELECT dom, 2, DATE '2024-01-01' + d3 FROM dm UNION ALL SELECT dom, 0, DATE '2024-01-01' + d3 + 60 FROM dm),
g AS (SELECT k, f, max(s) AS s FROM e GROUP BY k, f),
v AS (SELECT k, f, s, coalesce(lead(f) OVER (PARTITION BY k ORDER BY f), DATE '9999-12-31') AS t FROM g),
c AS (SELECT DISTINCT host, fetch_date FROM p WHERE host IS NOT NULL),
a AS (SELECT host, fetch_date, k, f, s, row_number() OVER (PARTITION BY host, fetch_date ORDER BY length(k) DESC) AS r FROM c JOIN v ON (host = k OR ends_with(host, '.' || k)) AND fetch_date >= f AND fetch_date < t AND s > 0)
SELECT page_id, p.host, p.fetch_date, CASE WHEN a.s = 2 THEN 'block' ELSE 'allow' END AS verdict, a.k AS list_key, a.f AS valid_from
FROM p LEFT JOIN a ON p.host = a.host AND p.fetch_date = a.fetch_date AND a.r = 1
"""
