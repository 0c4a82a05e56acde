"""Line-first cleaning: rules judge every line, failing lines go, and documents that lose too much text are rejected.
DataFrame functions only."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, WORD, documents, fresh_name, let

MIN_WORDS = 50
#: Percentage of words in repeated windows above which a document fails.
MAX_REPEATED = 50
#: A document whose surviving lines hold under this percentage of its words is rejected.
MIN_LEFT = 60
SYMBOLS = r"[#*$%&|<>]"
#: Bits of a window's position where it is sorted together with its hash.
INDEX_BITS = 20

#: Line rules. Punctuation: markup-like characters for over half the words, or those and exclamations for more than
#: all of them. Navigation: separators for a fifth of the words. Boilerplate: a stock phrase in a short line.
MARKUP = r"[#*$%&<>{}\\^~]"
EXCLAIMS = r"[!?]"
SEPARATORS = r"[|»›•]"
BOILERPLATE = (
    r"(?i)\b(cookie policy|cookies|privacy policy|terms of (use|service)|all rights reserved|copyright|javascript|lorem ipsum"
    r"|subscribe|newsletter|sign up|log ?in|click here|read more|share this|powered by|licensed under|skip to content)\b"
)
BOILERPLATE_WORDS = 40


def _count(text: Column, pattern: str) -> Column:
    """Characters of a class in a text."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def line_passes(line: Column) -> Column:
    def rules(c: Column) -> Column:
        words, markup, separators = c["words"], c["markup"], c["separators"]
        punctuation = (2 * markup > words) | (markup + c["exclaims"] > words)
        navigation = (separators >= 2) & (5 * separators >= words)
        boilerplate = (words <= BOILERPLATE_WORDS) & line.rlike(BOILERPLATE)
        return ~(punctuation | navigation | boilerplate)

    return let(
        F.struct(
            F.regexp_count(line, F.lit(WORD)).alias("words"), _count(line, MARKUP).alias("markup"), _count(line, EXCLAIMS).alias("exclaims"), _count(line, SEPARATORS).alias("separators"),
        ),
        rules,
    )


def _covered(starts: Column) -> Column:
    """Words that windows with these starts cover: each covers up to its successor, three words at most."""
    gaps = F.transform(starts, lambda s, k: F.least(F.lit(3), F.coalesce(F.get(starts, k + 1) - s, F.lit(3))))
    return F.aggregate(gaps, F.lit(0), lambda a, b: a + b).cast("long")


def _repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more. The windows' hashes, their last INDEX_BITS bits replaced
    by their positions, are sorted as longs; those whose neighbour has the same first bits are few, and whole hashes
    decide among them. Texts with more words than positions fit sort whole hashes."""
    n = F.size(words)
    w = lambda i: F.get(words, i)
    full = lambda i: F.xxhash64(w(i), w(i + 1), w(i + 2))
    positions = F.sequence(F.lit(0), n - 3)
    low = (1 << INDEX_BITS) - 1

    def near(order: Column) -> Column:
        same = lambda x, k: F.coalesce(F.shiftrightunsigned(x.bitwiseXOR(F.get(order, k)), INDEX_BITS) == 0, F.lit(False))
        return F.transform(F.filter(order, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x.bitwiseAND(F.lit(low)).cast("int"))

    def exact(candidates: Column) -> Column:
        def by_sorting(order: Column) -> Column:
            same = lambda k, x: F.coalesce(F.get(order, k)["h"] == x["h"], F.lit(False))
            return F.array_sort(F.transform(F.filter(order, lambda x, k: same(k - 1, x) | same(k + 1, x)), lambda x: x["i"]))

        whole = F.transform(candidates, lambda i: F.struct(full(i).alias("h"), i.alias("i")))
        return let(let(F.sort_array(whole), by_sorting), _covered)

    packed = F.transform(positions, lambda i: full(i).bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long")))
    return F.when(n < 3, F.lit(0).cast("long")).when(n > low, exact(positions)).otherwise(let(let(F.sort_array(packed), near), exact))


def measure(docs: DataFrame) -> DataFrame:
    """docs with a struct column named by fresh_name(docs, "_rules"): n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, n_lines_removed, words_left, clean_text, kept.

    Null text counts as empty: no words, so base_failed. Wordless lines are neither judged nor duplicates. Repeated
    rows get equal results; other columns pass through. The work is that of sorting a row's windows; nothing is shuffled."""
    name = fresh_name(docs, "_rules")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))

    def by_line(all_lines: Column) -> Column:
        def result(left: Column) -> Column:
            clean_text = F.array_join(left, "\n")
            return F.struct(
                (F.size(all_lines) - F.size(F.array_distinct(all_lines))).cast("long").alias("n_dup_lines"), (F.size(all_lines) - F.size(left)).cast("long").alias("n_lines_removed"),
                F.regexp_count(clean_text, F.lit(WORD)).cast("long").alias("words_left"), clean_text.alias("clean_text"),
            )

        return let(F.filter(all_lines, line_passes), result)

    by_word = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeated_words(w).alias("n_repeat_words")))
    figures = F.struct(
        by_word.alias("w"), let(lines, by_line).alias("l"), F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"), _count(text, SYMBOLS).cast("long").alias("n_symbols"),
    )

    def verdict(f: Column) -> Column:
        n, repeats = f["w"]["n_words"], f["w"]["n_repeat_words"]
        failed = (n < MIN_WORDS) | (100 * repeats > MAX_REPEATED * n)
        return F.struct(
            n.alias("n_words"), f["word_chars"].alias("word_chars"), f["n_symbols"].alias("n_symbols"), f["l"]["n_dup_lines"].alias("n_dup_lines"), repeats.alias("n_repeat_words"),
            failed.alias("base_failed"), f["l"]["n_lines_removed"].alias("n_lines_removed"), f["l"]["words_left"].alias("words_left"), f["l"]["clean_text"].alias("clean_text"),
            (~failed & (100 * f["l"]["words_left"] >= MIN_LEFT * n)).alias("kept"),
        )

    return docs.withColumn(name, let(figures, verdict))


def clean(docs: DataFrame) -> DataFrame:
    """The kept documents with their failing lines removed."""
    name = fresh_name(docs, "_rules")
    return measure(docs).filter(f"{name}.kept").withColumn("text", F.col(f"{name}.clean_text")).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = measure(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", *[f"_rules.{x}" for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_removed")])


ORACLE = (
    r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT r, unnest(range(1, len(w) - 1)) AS s, w FROM w WHERE len(w) >= 3),
g2 AS (SELECT r, s, count(*) OVER (PARTITION BY r, w[s], w[s + 1], w[s + 2]) AS c FROM g),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([s, s + 1, s + 2]) AS p FROM g2 WHERE c > 1) GROUP BY r),
ln AS (SELECT r, x, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n, len(regexp_extract_all(x, '[#*$%&<>{}\\^~]')) AS m, len(regexp_extract_all(x, '[!?]')) AS e, len(regexp_extract_all(x, '[|\x{BB}\x{203A}\x{2022}]')) AS p FROM (SELECT r, unnest(l) AS x FROM w)),
j AS (SELECT r, n, NOT (2 * m > n OR m + e > n OR (p >= 2 AND 5 * p >= n) OR (n <= 40 AND regexp_matches(x, '"""
    + BOILERPLATE
    + r"""'))) AS ok FROM ln),
jj AS (SELECT r, coalesce(sum(n) FILTER (WHERE ok), 0) AS words_left, count(*) FILTER (WHERE NOT ok) AS gone FROM j GROUP BY r),
f AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, coalesce(words_left, 0) AS words_left, CAST(coalesce(gone, 0) AS BIGINT) AS n_lines_removed
  FROM w LEFT JOIN rep USING (r) LEFT JOIN jj USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * words_left >= 60 * n_words AS kept, n_lines_removed FROM f
"""
)
