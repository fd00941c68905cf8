"""Line-first quality rules, in DataFrame functions only.

Each line is judged alone by punctuation, navigation and boilerplate rules;
failing lines are removed, and a document that loses too large a share of its
text is rejected.  Document-level counts (words, symbols, repeated lines and
repeated 5-word windows) come from array functions inside the row, so nothing
is shuffled and a hot key cannot arise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opexlens.llm.common import SPACES, WORD, let, table, words_of

WINDOW = 5
SYMBOLS = r"[#*$%&|<>]"
# Phrases of notices and page furniture, matched in short lines.
BOILERPLATE = (
    "all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie policy", "we use cookies", "accept cookies",
    "enable javascript", "javascript is disabled", "sign up for our newsletter", "subscribe to our newsletter", "click here",
    "back to top", "skip to content", "share on facebook", "lorem ipsum",
)
BOILERPLATE_MAX_WORDS = 25
SEPARATOR = r"[|»›•·]"


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def line_fails(line: Column) -> Column:
    """Whether a line breaks a rule.  Blank lines never fail.

    punctuation: a tenth of its characters are symbols, three in ten words
    carry doubled exclamation or question marks, or 40 words and more come
    without any punctuation mark; navigation: at least three menu separators,
    one for every four words or more; boilerplate: a short line with one of
    the fixed phrases."""
    n = F.regexp_count(line, F.lit(WORD))
    separators = F.regexp_count(line, F.lit(SEPARATOR))
    punctuation = ((F.regexp_count(line, F.lit(SYMBOLS)) * 10 >= F.length(line))
                   | (F.regexp_count(line, F.lit(r"[!?]{2,}")) * 10 >= n * 3)
                   | ((n >= 40) & ~line.rlike(r"\p{Punct}|\p{IsPunctuation}")))
    navigation = (separators >= 3) & (separators * 4 >= n)
    boilerplate = (n <= BOILERPLATE_MAX_WORDS) & F.lower(line).rlike("|".join(BOILERPLATE))
    return (n > 0) & (punctuation | navigation | boilerplate)


def window_hashes(words: Column, k: int = WINDOW) -> Column:
    """Hash of every run of k consecutive words (``words``: bound by let,
    with at least k entries)."""
    return F.transform(F.sequence(F.lit(0), F.size(words) - k),
                       lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))


def repeated_words(words: Column, k: int = WINDOW) -> Column:
    """Number of words inside windows of k words that occur at least twice.
    Positions are sorted by window hash, so equal windows are neighbours."""
    def covered(h: Column) -> Column:
        by_hash = F.sort_array(F.transform(h, lambda x, p: F.struct(x.alias("h"), p.alias("p"))))

        def twins(s: Column) -> Column:
            again = F.filter(s, lambda e, j: _true(F.get(s, j - 1)["h"] == e["h"]) | _true(F.get(s, j + 1)["h"] == e["h"]))
            return F.sort_array(F.transform(again, lambda e: e["p"]))

        def length(p: Column) -> Column:
            steps = F.transform(p, lambda x, j: F.least(F.lit(k), F.coalesce(F.get(p, j + 1) - x, F.lit(k))))
            return F.aggregate(steps, F.lit(0), lambda a, b: a + b)
        return let(let(by_hash, twins), length)

    return F.when(F.size(words) < k, F.lit(0)).otherwise(let(
        window_hashes(words, k),
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))))


def rate(df: DataFrame, text: str = "text", max_lost: float = 0.5, min_words: int = 10, max_repeat_pct: int = 20) -> DataFrame:
    """``df`` plus a struct column ``quality``: n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words, base_failed, clean_text (lines
    that pass, joined by a line feed), lost_share (of characters) and kept.

    Null and blank texts have no words: base_failed, not kept, lost_share 0.
    Repeated rows fare alike, an empty table gives no rows, and whole texts are
    judged, of any length (n log n in their words).  A column of ``df`` named quality is replaced."""
    value = F.coalesce(F.col(text), F.lit(""))
    counts = let(words_of(value), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        repeated_words(w).cast("long").alias("n_repeat_words")))
    lines = let(F.filter(F.split(value, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != ""), lambda full: F.struct(
        (F.size(full) - F.size(F.array_distinct(full))).cast("long").alias("n_dup_lines"),
        let(F.filter(full, lambda x: ~line_fails(x)), lambda good: F.struct(
            F.array_join(good, "\n").alias("clean_text"),
            F.coalesce(1 - F.length(F.array_join(good, "")) / F.nullif(F.length(F.array_join(full, "")), F.lit(0)), F.lit(0.0)).alias("lost_share"))).alias("c")))
    names = df.columns
    got = df.select(*[F.col(f"`{c}`") for c in names if c != "quality"], counts.alias("__counts"), lines.alias("__lines"),
                    F.regexp_count(value, F.lit(SYMBOLS)).cast("long").alias("__symbols"))
    n, repeats, lost = F.col("__counts.n_words"), F.col("__counts.n_repeat_words"), F.col("__lines.c.lost_share")
    failed = (n < min_words) | (repeats * 100 > n * max_repeat_pct)
    return got.withColumn("quality", F.struct(
        n.alias("n_words"), F.col("__counts.word_chars").alias("word_chars"), F.col("__symbols").alias("n_symbols"),
        F.col("__lines.n_dup_lines").alias("n_dup_lines"), repeats.alias("n_repeat_words"), failed.alias("base_failed"),
        F.col("__lines.c.clean_text").alias("clean_text"), lost.alias("lost_share"),
        (~failed & (lost <= max_lost)).alias("kept"))).drop("__counts", "__lines", "__symbols")


def op5_quality(spark, sf_dir: str) -> DataFrame:
    rated = rate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rated.select("doc_id", *[F.col(f"quality.{c}").alias(c) for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


_PHRASES = "|".join(BOILERPLATE)
# Words, lines and windows by unnesting; the verdict applies the same rules to
# each line.  Written apart from the DataFrame expressions above.
OP5_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT id, i, list_slice(w, i, i + 4) AS g FROM d, unnest(generate_series(1, len(w) - 4)) AS t(i) WHERE len(w) >= 5),
twice AS (SELECT id, g FROM win GROUP BY id, g HAVING count(*) > 1),
cover AS (SELECT id, count(DISTINCT i + j) AS c FROM win JOIN twice USING (id, g), generate_series(0, 4) AS s(j) GROUP BY id),
ln AS (SELECT id, line, length(line) AS chars, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n
       FROM (SELECT id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
judged AS (SELECT *, len(regexp_extract_all(line, '[#*$%&|<>]')) * 10 >= chars
    OR len(regexp_extract_all(line, '[!?][!?]+')) * 10 >= n * 3
    OR (n >= 40 AND NOT regexp_matches(line, '[[:punct:]]|\pP'))
    OR (len(regexp_extract_all(line, '[|»›•·]')) >= 3 AND len(regexp_extract_all(line, '[|»›•·]')) * 4 >= n)
    OR (n <= 25 AND regexp_matches(lower(line), '{_PHRASES}')) AS bad FROM ln),
lines AS (SELECT id, count(*) - count(DISTINCT line) AS dups, 1 - sum(CASE WHEN bad THEN 0 ELSE chars END)::DOUBLE / sum(chars) AS lost
          FROM judged GROUP BY id),
base AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dups, 0)::BIGINT AS n_dup_lines,
    coalesce(c, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0) AS lost
    FROM d LEFT JOIN lines USING (id) LEFT JOIN cover USING (id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
    (NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND lost <= 0.5) AS kept FROM base
"""
