"""Operator 5: line-first quality rules, in DataFrame functions only.

Every line is judged by itself (end punctuation, navigation, boilerplate); failing
lines are removed; a document that loses too much of its text, or fails the
document rules, is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "\\x20\\x09-\\x0D"
SYMBOLS = "#*$%&|<>"

# Phrases that mark a short line as page furniture.
BOILERPLATE = [
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "accept cookies",
    "use cookies", "enable javascript", "sign in", "log in", "sign up", "subscribe", "newsletter", "read more",
    "click here", "share this", "follow us", "back to top", "skip to content", "powered by", "lorem ipsum",
]


def words(text: Column) -> Column:
    """Runs of characters that are not white space."""
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def words_in_repeated_windows(all_words: Column, width: int = 3) -> Column:
    """How many words lie in a window of width words that occurs at least twice in the array.

    Windows are compared by a 64-bit hash. Sorted with their places, equal ones are
    neighbours; the places of those cover the words.
    """
    n = F.size(all_words) - (width - 1)
    hashes = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.xxhash64(F.slice(all_words, i, width)).alias("h"), i.alias("i")))
    ordered = F.sort_array(hashes)

    def repeated(sorted_hashes: Column) -> Column:
        later = F.slice(sorted_hashes, 2, F.greatest(F.size(sorted_hashes) - 1, F.lit(0)))
        pairs = F.filter(
            F.arrays_zip(sorted_hashes.alias("a"), later.alias("b")), lambda p: p["a"]["h"] == p["b"]["h"]
        )
        starts = F.flatten(F.transform(pairs, lambda p: F.array(p["a"]["i"], p["b"]["i"])))
        return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.sequence(i, i + (width - 1))))))

    return F.when(n < 2, F.lit(0)).otherwise(F.element_at(F.transform(F.array(ordered), repeated), 1)).cast("long")


def failed_line(line: Column) -> Column:
    """Whether a line with words fails: a navigation bar, boilerplate, or mostly symbols instead of prose.

    Navigation: three separators or more, as many as a third of the words. Boilerplate:
    at most twelve words (200 characters) with a phrase of BOILERPLATE. Punctuation: a line of twenty
    words or more without any sentence mark, or symbols in over a quarter of the words.
    """
    n = F.regexp_count(line, F.lit(f"[^{SPACE}]+"))
    separators = F.regexp_count(line, F.lit("[|»>·•]"))
    symbols = F.regexp_count(line, F.lit("[#*$%&|<>!]"))
    furniture = (F.length(line) <= 200) & F.lower(line).rlike("|".join(BOILERPLATE)) & (n <= 12)
    unpunctuated = ~line.rlike("[.!?:;,…。！？]") & (n >= 20)
    return (separators >= 3) & (3 * separators >= n) | furniture | unpunctuated | (symbols >= 3) & (4 * symbols > n)


def judge(
    docs: DataFrame, *, min_words: int = 50, max_repeated_percent: int = 50, max_lost_percent: int = 50
) -> DataFrame:
    """Counts, line verdicts and the document verdict of every row.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, n_lines, n_failed_lines, lost_chars, cleaned (the text without failed
    lines), kept. A line counts as lost with all its characters; the document is
    kept if its base rules hold and at most max_lost_percent of the characters of its
    lines are lost. A null text has no words, so it fails; so does an empty one. One
    row out for each row in, repeated rows included; further columns are ignored.
    """
    with_words = F.filter(F.col("lines"), lambda x: x.rlike(f"[^{SPACE}]"))
    n_failed = F.size("failed")
    lost = F.aggregate("failed", F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    total = F.aggregate("full", F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    return (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .withColumn("words", words(F.col("text")))
        .withColumn("lines", F.split("text", "\n"))
        .withColumn("full", with_words)
        .withColumn("failed", F.filter("full", failed_line))
        .select(
            "doc_id",
            F.size("words").cast("long").alias("n_words"),
            F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
            F.regexp_count("text", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
            (F.size("full") - F.size(F.array_distinct("full"))).cast("long").alias("n_dup_lines"),
            words_in_repeated_windows(F.col("words")).alias("n_repeat_words"),
            F.size("full").cast("long").alias("n_lines"),
            n_failed.cast("long").alias("n_failed_lines"),
            lost.alias("lost_chars"),
            total.alias("line_chars"),
            F.when(n_failed == 0, F.col("text"))
            .otherwise(F.array_join(F.filter("lines", lambda x: ~(x.rlike(f"[^{SPACE}]") & failed_line(x))), "\n"))
            .alias("cleaned"),
        )
        .withColumn(
            "base_failed",
            (F.col("n_words") < min_words) | (F.lit(100) * F.col("n_repeat_words") > F.lit(max_repeated_percent) * F.col("n_words")),
        )
        .withColumn("kept", ~F.col("base_failed") & (F.lit(100) * F.col("lost_chars") <= F.lit(max_lost_percent) * F.col("line_chars")))
        .drop("line_chars")
    )
