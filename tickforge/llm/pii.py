"""Personal data by bootstrapped contextual extraction: entities of known form are seeds, the words around them
become patterns, and patterns that hold mostly seeds find identifiers of unknown form. DataFrame functions only."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, let, materialize

KINDS = ("email", "ip", "card", "phone")
# Possessive repeats and a test of the character before keep each scan linear: within a run of one class only its
# start, or the end of the last match, can begin a match.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # Identifiers of unknown form: groups of digits joined by blanks, brackets, dots or hyphens, and a token of these
    # characters that holds a digit or an @ (neither ends in punctuation).
    "group": r"(?<![A-Za-z0-9@._%+-])[+(]{0,2}+[0-9]++(?:[\x20().-]{1,3}+[0-9]++)++(?:[._%+-]*+[A-Za-z0-9@]++)*+",
    "other": r"(?<![A-Za-z0-9@._%+-])(?=[A-Za-z._%+-]*+[0-9@])[._%+-]*+[A-Za-z0-9@]++(?:[._%+-]++[A-Za-z0-9@]++)*+",
}
#: Code points on either side of an entity in which its two words of context stand.
CONTEXT = 64
#: A pattern counts from this many different seeds, and finds identifiers from this score on.
MIN_SEEDS = 3
MIN_SCORE = 0.6
#: An identifier found with this certainty is a seed for further patterns.
MIN_SURE = 0.8
#: Weight of doubt in a pattern's score.
PRIOR = 1.0
ROUNDS = 3

_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    n = F.length(digits)
    value = lambda i: F.substring(digits, n - i, F.lit(1)).cast("int")
    doubled = lambda i: F.when(i % 2 == 0, value(i)).when(value(i) > 4, 2 * value(i) - 9).otherwise(2 * value(i))
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + doubled(i)) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        return m.rlike(rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$")
    if kind == "card":
        return F.when(n.between(16, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


def _found(text: Column, kind: str, gate: Column) -> Column:
    """An array of (kind, m, gap, before, after) for each match in order: the match, the length of the text since
    the last one, and up to CONTEXT code points on either side."""
    def items(gaps: Column) -> Column:
        def item(m: Column, i: Column) -> Column:
            gap, after = F.get(gaps, i), F.get(gaps, i + 1)
            return F.struct(
                F.lit(kind).alias("kind"), i.alias("nth"), m.alias("m"), F.length(gap).alias("gap"), F.right(gap, F.lit(CONTEXT)).alias("before"), F.left(after, F.lit(CONTEXT)).alias("after"),
            )

        return F.transform(F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)), item)

    nothing = F.array().cast("array<struct<kind:string,nth:int,m:string,gap:int,before:string,after:string>>")
    return F.when(gate, let(F.split(text, PATTERNS[kind], -1), items)).otherwise(nothing)


def _scan(docs: DataFrame) -> DataFrame:
    """(uid, doc_id, found): every match of every kind, one row a document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    digit = F.col("text").rlike("[0-9]")
    gates = {"email": F.contains("text", F.lit("@")), "ip": digit, "card": digit, "phone": F.contains("text", F.lit("+")), "group": digit, "other": digit | F.contains("text", F.lit("@"))}
    rows = rows.select("doc_id", F.concat(*[_found(F.col("text"), k, g) for k, g in gates.items()]).alias("found"))
    return rows.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "found")


def _spans(scanned: DataFrame) -> DataFrame:
    """One row for each valid match: uid, kind, rank, start, end, value, before, after. `other` only where it does
    not touch a known entity, and a group of digits before the tokens within it. Rows of a document are brought together once; all windows keep that partitioning."""
    rows = scanned.filter(F.size("found") > 0).select("uid", F.explode("found").alias("f")).select("uid", "f.*")
    order = Window.partitionBy("uid", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.repartition("uid").withColumn("end", F.sum(F.col("gap") + F.length("m")).over(order)).withColumn("start", F.col("end") - F.length("m"))
    valid = F.lit(False)
    for kind in PATTERNS:
        valid = F.when(F.col("kind") == kind, _valid(kind, F.col("m"))).otherwise(valid)
    rows = rows.filter(valid).withColumn("known", F.col("kind").isin(*KINDS))
    by = Window.partitionBy("uid").orderBy("start")
    reach = F.max(F.when(F.col("known"), F.col("end"))).over(by.rangeBetween(Window.unboundedPreceding, 0))
    ahead = F.min(F.when(F.col("known"), F.col("start"))).over(by.rangeBetween(0, Window.unboundedFollowing))
    rows = rows.withColumns({"_reach": reach, "_ahead": ahead})
    clear = (F.coalesce("_reach", F.lit(-1)) <= F.col("start")) & (F.coalesce("_ahead", F.col("end")) >= F.col("end"))
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    rows = rows.filter(F.col("known") | clear)
    grouped = F.max(F.when(F.col("kind") == "group", F.col("end"))).over(by.rangeBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_grouped", grouped).filter((F.col("kind") != "other") | (F.coalesce("_grouped", F.lit(-1)) <= F.col("start")))
    rows = rows.withColumn("kind", F.when(F.col("known"), F.col("kind")).otherwise("other"))
    return rows.select("uid", "kind", rank.cast("int").alias("rank"), "start", "end", F.lower("m").alias("value"), "before", "after")


def _patterns() -> Column:
    """The lexical patterns of an occurrence: its two words before, and one word on either side. Digits in words
    are one symbol, punctuation at their ends goes."""
    tidy = lambda c: F.regexp_replace(F.regexp_replace(F.lower(c), "[0-9]+", "0"), r"[^\p{L}0@:#=\s]", "")
    before, after = tidy(F.col("before")), tidy(F.col("after"))
    two, one, nxt = F.regexp_extract(before, r"(\S+\s+\S+)\s*$", 1), F.regexp_extract(before, r"(\S+)\s*$", 1), F.regexp_extract(after, r"^\s*(\S+)", 1)
    return F.filter(
        F.array(F.when(two != "", F.concat(F.lit("L:"), F.regexp_replace(two, r"\s+", " "))), F.when((one != "") & (nxt != ""), F.concat(F.lit("B:"), one, F.lit(" _ "), nxt))),
        lambda x: x.isNotNull(),
    )


def _score_patterns(edges: DataFrame) -> DataFrame:
    """edges: pattern, kind, value (distinct). Returns (pattern, kind, score) of the patterns that count.

    A seed is certain to be of its kind; a pattern's score for a kind is the certainty of its instances over their
    number plus PRIOR; an unknown instance is as certain as its best pattern. The two are computed in turn, as joins
    of grouped sums. Instances of MIN_SURE or more then count as seeds, until no further ones come: each generation's
    finds can make patterns that no entity of known form stands in."""
    known = edges.filter("kind <> 'other'").groupBy("pattern", F.col("kind").alias("of")).agg(F.count("*").alias("seeds"))
    known = materialize(known.select("pattern", "of", "seeds", F.col("seeds").cast("double").alias("certain"), F.col("seeds").alias("base")), "seeds")
    others = edges.filter("kind = 'other'").select("pattern", "value")
    sizes = edges.groupBy("pattern").agg(F.countDistinct("value").alias("n"))
    votes, before = known, 0
    while True:
        # Patterns without enough different seeds cannot count, nor pass certainty on.
        seeded = votes.groupBy("pattern", "of").agg(F.sum("seeds").alias("seeds"), F.sum("certain").alias("certain"), F.sum("base").alias("base")).filter(F.col("seeds") >= MIN_SEEDS)
        base = materialize(seeded.join(sizes, "pattern").withColumn("score", F.col("certain") / (F.col("n") + PRIOR)), "patterns")
        unknown = materialize(others.join(base.select("pattern").distinct(), "pattern", "left_semi"), "instances")
        scores = base
        for _ in range(ROUNDS):
            certain = unknown.join(scores.select("pattern", "of", "score"), "pattern").groupBy("value", "of").agg(F.max("score").alias("sure"))
            gained = unknown.join(certain, "value").groupBy("pattern", "of").agg(F.sum("sure").alias("gain"))
            scores = base.drop("score").join(gained, ["pattern", "of"], "left").withColumn("score", (F.col("base") + F.coalesce("gain", F.lit(0.0))) / (F.col("n") + PRIOR))
            scores = materialize(scores.withColumn("score", F.round("score", 9)), "scores")
        certain = unknown.join(scores.select("pattern", "of", "score"), "pattern").groupBy("value", "of").agg(F.max("score").alias("sure"))
        sure = materialize(certain.filter(F.col("sure") >= MIN_SURE), "sure")
        now = sure.count()
        if now <= before:
            break
        before = now
        gain = others.join(sure, "value").groupBy("pattern", "of").agg(F.count("*").alias("seeds"), F.sum("sure").alias("certain"))
        votes = known.unionByName(gain.withColumn("base", F.lit(0).cast("long")))
    return scores.select("pattern", F.col("of").alias("kind"), "score")


def find(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, base (array of kind, start, end: entities of known form), added (the like:
    identifiers found by context, under the kind of their pattern). Starts and ends count code points.

    Every whole text is scanned. Null text is empty; a null id is kept; repeated rows get equal results and count
    once as evidence (instances are distinct values). Ties between kinds go to the first listed. Documents meet only
    as aggregates of patterns and values; no group of rows is gathered but a document's own spans."""
    scanned = materialize(_scan(docs), "matches")
    spans = materialize(_spans(scanned), "spans")
    occurs = spans.withColumn("pattern", F.explode(_patterns()))
    edges = materialize(occurs.groupBy("pattern", "kind", "value").agg(F.count("*").alias("n")), "edges")
    strong = _score_patterns(edges).filter(F.col("score") >= MIN_SCORE)
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    best = strong.groupBy("pattern").agg(F.max(F.struct("score", (-rank).alias("r"), "kind")).alias("b")).select("pattern", F.col("b.score").alias("score"), F.col("b.kind").alias("kind"))
    hits = occurs.filter("kind = 'other'").select("uid", "start", "end", "pattern").join(best, "pattern")
    new = hits.groupBy("uid", "start", "end").agg(F.max(F.struct("score", (-rank).alias("r"), "kind")).alias("b"))
    new = new.select("uid", "start", "end", F.col("b.kind").alias("kind"))
    new = new.withColumn("rank", rank.cast("int"))
    both = spans.filter("kind <> 'other'").select("uid", "rank", "kind", "start", "end", F.lit(True).alias("known")).unionByName(new.withColumn("known", F.lit(False)))
    item = F.struct("rank", "start", "end", "kind")
    listed = both.groupBy("uid").agg(F.sort_array(F.collect_list(F.when(F.col("known"), item))).alias("base"), F.sort_array(F.collect_list(F.when(~F.col("known"), item))).alias("added"))
    none = F.array().cast("array<struct<rank:int,start:bigint,end:bigint,kind:string>>")
    return scanned.select("uid", "doc_id").join(listed, "uid", "left").select("doc_id", F.coalesce("base", none).alias("base"), F.coalesce("added", none).alias("added"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(documents(spark, sf_dir).select("doc_id", "text"))
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [of_kind(k).alias(f"n_{k}") for k in KINDS]
    everything = F.sort_array(F.concat("base", "added"))
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(everything).alias("spans"), F.size("added").cast("long").alias("n_added"))
