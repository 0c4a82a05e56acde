"""Mixing sources to target weights by hierarchical budgeting over a domain-language-source tree. DataFrame functions
only."""

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, documents, fresh_name, fresh_names, materialize, same_columns

LEVELS = ("domain", "language", "source")


@dataclass(frozen=True)
class Mix:
    """Whole-number weights, relative to siblings; the budget in percent of the tokens there are; the most epochs a
    leaf may give. Names without a weight get `other`. A weight of 0 switches a domain, language or source off."""

    domains: dict[str, int] = field(default_factory=lambda: {"web": 40, "news": 30, "forum": 20, "reference": 10})
    languages: dict[str, int] = field(default_factory=lambda: {"en": 50, "fr": 20, "de": 20, "es": 10})
    sources: dict[str, int] = field(default_factory=dict)
    other: int = 10
    budget_percent: int = 60
    max_epochs: int = 2
    seed: int = 20


#: The corpus has no domain column: it is read off the number at the end of the source.
DOMAINS = ("web", "news", "forum", "reference")


def domain_of(source: Column) -> Column:
    digits = F.regexp_extract(source, "([0-9]{1,9})$", 1)
    number = F.when(digits == "", F.lit(0)).otherwise(digits.try_cast("int"))
    return F.get(F.array(*[F.lit(d) for d in DOMAINS]), F.coalesce(F.pmod(number, F.lit(len(DOMAINS))), F.lit(0)))


def _weight(name: Column, weights: dict[str, int], other: int) -> Column:
    out = F.lit(other)
    for k, v in weights.items():
        out = F.when(name == k, F.lit(v)).otherwise(out)
    return out.cast("long")


def _share(nodes: DataFrame, parent: list[str], budget: str, capacity: str, weight: str, into: str) -> DataFrame:
    """Divides each parent's budget among its children by weight, none above its capacity; what short children leave
    goes to their siblings by weight. In order of capacity per weight, the level is (budget - capacity before) /
    weight left, greatest at the first child that the level does not fill; min(capacity, weight * level) follows."""
    by = Window.partitionBy(*parent)
    order = by.orderBy(F.col(capacity) / F.col(weight), *[c for c in LEVELS if c in nodes.columns and c not in parent])
    before = F.coalesce(F.sum(capacity).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum(weight).over(order.rowsBetween(0, Window.unboundedFollowing))
    levelled = nodes.withColumn("_level", (F.col(budget) - before).cast("double") / left.cast("double"))
    level = F.max("_level").over(by)
    return levelled.withColumn(into, F.least(F.col(capacity), F.floor(F.greatest(F.lit(0.0), F.col(weight).cast("double") * level)))).drop("_level")


def _keys(domain: Column) -> dict[str, Column]:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return {
        "domain": F.coalesce(domain, F.lit("")), "language": F.coalesce(F.col("lang").cast("string"), F.lit("")), "source": F.coalesce(F.col("source").cast("string"), F.lit("")),
        "tokens": F.regexp_count(text, F.lit(WORD)).cast("long"), "row_key": F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(text)),
    }


def order_key(row_key: Column, seed: int, epoch: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), row_key))


def plan(slim: DataFrame, mix: Mix) -> DataFrame:
    """slim: domain, language, source, tokens, row_key. One row for each leaf of the tree: tokens, budget (capacity in
    tokens that the mix gives it), epochs (full ones) and cutoff (the last order key of the following, partial
    epoch; null takes none).

    Budgets run down the tree and capacities up, so a leaf's shortage goes to its sibling sources first, a short
    language's to its sibling languages next, and a short domain's to the other domains. The prefix of the partial
    epoch is found from token sums of 4096 hash buckets; only the bucket in which it ends is ordered row by row, so
    a leaf with a third of all rows is never in one task."""
    leaves = slim.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))
    weights = {"domain": (mix.domains, "wd"), "language": (mix.languages, "wl"), "source": (mix.sources, "ws")}
    off = F.lit(False)
    for level, (table, name) in weights.items():
        off = off | (_weight(F.col(level), table, mix.other) <= 0)
        leaves = leaves.withColumn(name, F.greatest(F.lit(1), _weight(F.col(level), table, mix.other)))
    # What is switched off has no capacity, and its siblings share as if it were not there.
    leaves = leaves.withColumn("off", off).withColumn("capacity", F.when(F.col("off"), 0).otherwise(F.col("tokens") * mix.max_epochs))
    langs = leaves.groupBy("domain", "language").agg(
        F.sum("tokens").alias("lang_tokens"), F.sum("capacity").alias("lang_capacity"), F.first("wl").alias("wl"), F.first("wd").alias("wd"),
    )
    domains = langs.groupBy("domain").agg(F.sum("lang_tokens").alias("domain_tokens"), F.sum("lang_capacity").alias("domain_capacity"), F.first("wd").alias("wd"))
    total = F.floor(F.sum("domain_tokens").over(Window.partitionBy(F.lit(0))) * mix.budget_percent / 100)
    domains = _share(domains.withColumn("_root", F.lit(0)).withColumn("_total", total.cast("long")), ["_root"], "_total", "domain_capacity", "wd", "domain_budget")
    langs = _share(langs.join(domains.select("domain", "domain_budget"), "domain"), ["domain"], "domain_budget", "lang_capacity", "wl", "lang_budget")
    leaves = _share(leaves.join(langs.select("domain", "language", "lang_budget"), ["domain", "language"]), ["domain", "language"], "lang_budget", "capacity", "ws", "budget")
    leaves = materialize(leaves.select(*LEVELS, "tokens", F.col("budget").cast("long").alias("budget"), "off"), "budgets")
    full = F.when(F.col("off"), 0).when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(F.lit(mix.max_epochs))
    leaves = leaves.withColumn("epochs", full.cast("int"))
    partial = leaves.withColumn("left", F.col("budget") - F.col("epochs") * F.col("tokens")).filter("left > 0")
    # The epoch's number is the leaf's, so keys are made after the leaf is known.
    keyed = slim.join(partial.select(*LEVELS, "epochs", "left"), list(LEVELS)).withColumn("key", order_key(F.col("row_key"), mix.seed, F.col("epochs")))
    # Written, so that what follows is dealt by leaf and bucket and not by leaf.
    keyed = materialize(keyed.select(*LEVELS, "left", "tokens", "key", F.substring("key", 1, 3).alias("bucket")), "keys")
    sums = keyed.groupBy(*LEVELS, "left", "bucket").agg(F.sum("tokens").alias("n"))
    w = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("upto", F.sum("n").over(w))
    whole = sums.filter("upto <= left").groupBy(*LEVELS).agg(F.max("bucket").alias("whole"))
    edge = sums.filter("upto > left and upto - n < left").select(*LEVELS, "bucket", (F.col("left") - F.col("upto") + F.col("n")).alias("room"))
    inside = keyed.join(edge, [*LEVELS, "bucket"])
    rw = Window.partitionBy(*LEVELS, "bucket").orderBy("key").rangeBetween(Window.unboundedPreceding, 0)
    last = inside.withColumn("upto", F.sum("tokens").over(rw)).filter("upto <= room").groupBy(*LEVELS).agg(F.max("key").alias("last"))
    cut = whole.join(last, list(LEVELS), "full_outer").select(*LEVELS, F.greatest(F.concat("whole", F.lit("~")), "last").alias("cutoff"))
    return materialize(leaves.join(cut, list(LEVELS), "left"), "mix")


def mix_documents(docs: DataFrame, mix: Mix = Mix(), domain: Column | None = None) -> DataFrame:
    """docs with a column `copies` (by fresh_name): how often the mix takes the document, once for each of its leaf's
    full epochs and once more if it is in the token prefix of the next, whose order the seed gives.

    Null domains, languages and sources are the name "". Null text has no tokens; a leaf without tokens gives all its
    rows max_epochs times. Rows equal in doc_id and text are in or out together. Other columns pass through, and an
    empty table gives no rows."""
    name = fresh_name(docs, "copies")
    cols = _keys(domain_of(F.col("source").cast("string")) if domain is None else domain)
    slim = materialize(docs.select(*[v.alias(k) for k, v in cols.items()]), "tokens")
    key = fresh_names(docs, *[f"_key_{c}" for c in cols])
    leaf = fresh_names(docs, *[f"_leaf_{c}" for c in (*LEVELS, "epochs", "cutoff")])
    # One row a leaf.
    leaves = plan(slim, mix).select(*[F.col(c.removeprefix("_leaf_")).alias(n) for c, n in leaf.items()])
    tmp = docs.withColumns({key[f"_key_{c}"]: v for c, v in cols.items() if c != "tokens"})
    out = tmp.join(leaves, [F.col(key[f"_key_{c}"]) == F.col(leaf[f"_leaf_{c}"]) for c in LEVELS])
    epochs = F.col(leaf["_leaf_epochs"])
    taken = order_key(F.col(key["_key_row_key"]), mix.seed, epochs) <= F.col(leaf["_leaf_cutoff"])
    return out.select(*same_columns(docs), (epochs + F.coalesce(taken, F.lit(False)).cast("int")).alias(name))


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The documents of the mix, each as often as it is taken."""
    name = fresh_name(docs, "copies")
    out = mix_documents(docs, mix).filter(F.col(name) > 0)
    if mix.max_epochs > 1:
        out = out.withColumn(name, F.explode(F.sequence(F.lit(1), F.col(name))))
    return out.select(*same_columns(docs))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", "source")
    return mix_documents(docs).select("doc_id", domain_of(F.col("source")).alias("domain"), "lang", "source", "copies")


def _case(name: str, weights: dict[str, int]) -> str:
    return "CASE " + " ".join(f"WHEN {name} = '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 10 END"


def _oracle(mix: Mix) -> str:
    share = """least({cap}, CAST(floor(greatest(0.0, CAST({w} AS DOUBLE) * max(lv) OVER (PARTITION BY {p}))) AS BIGINT))"""
    level = """CAST({b} - coalesce(sum({cap}) OVER (PARTITION BY {p} ORDER BY {cap} / {w}, {o} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
      / CAST(sum({w}) OVER (PARTITION BY {p} ORDER BY {cap} / {w}, {o} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE)"""
    d, la, s = ({"p": "1", "b": "total", "cap": "cap", "w": "wd", "o": "domain"}, {"p": "domain", "b": "db", "cap": "cap", "w": "wl", "o": "language"}, {"p": "domain, language", "b": "lb", "cap": "cap", "w": "10", "o": "source"})
    return rf"""
WITH k AS (SELECT doc_id, lang, source AS src, coalesce(lang, '') AS language, coalesce(source, '') AS source,
  ['web', 'news', 'forum', 'reference'][coalesce(TRY_CAST(nullif(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1), '') AS INTEGER), 0) % 4 + 1] AS domain,
  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS tokens, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, '')) AS row_key FROM documents),
leaf AS (SELECT domain, language, source, sum(tokens)::BIGINT AS tokens, sum(tokens)::BIGINT * {mix.max_epochs} AS cap FROM k GROUP BY ALL),
l1 AS (SELECT domain, language, sum(cap)::BIGINT AS cap, {_case("language", mix.languages)} AS wl FROM leaf GROUP BY ALL),
d0 AS (SELECT domain, sum(cap)::BIGINT AS cap, {_case("domain", mix.domains)} AS wd FROM l1 GROUP BY domain),
d1 AS (SELECT *, CAST(floor((sum(cap) OVER ())::BIGINT * {mix.budget_percent} / ({100 * mix.max_epochs})) AS BIGINT) AS total FROM d0),
d2 AS (SELECT *, {level.format(**d)} AS lv FROM d1),
d3 AS (SELECT domain, {share.format(**d)} AS db FROM d2),
l2 AS (SELECT l1.*, db FROM l1 JOIN d3 USING (domain)), l3 AS (SELECT *, {level.format(**la)} AS lv FROM l2), l4 AS (SELECT domain, language, {share.format(**la)} AS lb FROM l3),
s2 AS (SELECT leaf.*, lb FROM leaf JOIN l4 USING (domain, language)), s3 AS (SELECT *, {level.format(**s)} AS lv FROM s2), s4 AS (SELECT domain, language, source, tokens, {share.format(**s)} AS budget FROM s3),
s5 AS (SELECT *, CAST(CASE WHEN tokens > 0 THEN budget // tokens ELSE {mix.max_epochs} END AS INTEGER) AS epochs FROM s4),
r AS (SELECT k.*, epochs, budget - epochs * s5.tokens AS room, md5('{mix.seed}:' || epochs || ':' || row_key) AS key FROM k JOIN s5 USING (domain, language, source)),
u AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, language, source ORDER BY key RANGE UNBOUNDED PRECEDING) AS upto FROM r)
SELECT doc_id, domain, lang, src AS source, CAST(epochs + CASE WHEN room > 0 AND upto <= room THEN 1 ELSE 0 END AS INTEGER) AS copies FROM u
"""


ORACLE = _oracle(Mix())
