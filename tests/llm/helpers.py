"""Awkward rows that every operator must take, and their schema."""

AWKWARD = [
    (1, None, "en", "s", None),
    (2, "", "en", "s", 0),
    (3, " \t\n\n ", None, None, 5),
    (4, "Eins zwei drei vier fünf sechs sieben acht.\nZeile zwei.", "de", "s", 55),
    (4, "Eins zwei drei vier fünf sechs sieben acht.\nZeile zwei.", "de", "s", 55),
    (None, "one two three four five six seven eight nine ten", "en", None, 47),
    (None, None, None, None, None),
    (7, "word " * 40_000, "en", "s", 200_000),
    (8, "x" * 50_000, "en", "s", 50_000),
    (9, "日本語 текст \U0001f600 'tis 12½ “quoted”", "en", "s", 30),
    (10, "a", "en", "s", 1),
    (11, "a<|endoftext|>b <|STARTOFTEXT|> \x00 K", "en", "s", 40),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["score", "ids", "row", "run", "block", "sequence_id", "length", "path", "chunk", "set_id", "edited", "words", "label", "_id"]


def awkward(spark, clashing=True):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(AWKWARD, SCHEMA)
    return docs.select("*", *(F.lit(f"other {c}").alias(c) for c in CLASHING)) if clashing else docs


def empty(spark):
    return awkward(spark).limit(0)
