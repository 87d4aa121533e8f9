"""Operator 3: license scan by diagonal voting, in DataFrame functions only.

All rolling word pairs of the texts are joined to the pairs' places in the license
templates. A match votes for its diagonal (place in the text minus place in the
template); a template that stands in the text word for word gets all its votes on one
diagonal, and inserted or missing words spread them over neighbouring ones, which are
merged before a span is verified.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases whose every exact place counts, and their labels.
BASE_PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

# Longer license wording, and its labels.
TEMPLATES = [
    ("licensed under the apache license version 2 0", "apache-2.0"),
    (
        "you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "http www apache org licenses license 2 0",
        "apache-2.0",
    ),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
        "public license as published by the free software foundation",
        "gpl",
    ),
    ("licensed under cc by 4 0", "cc-by-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction",
        "mit",
    ),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that "
        "the following conditions are met",
        "bsd",
    ),
    (
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        "mpl-2.0",
    ),
]


def words(text: Column) -> Column:
    """Words with A-Z lower-cased: runs of letters and digits of ASCII and of all characters beyond."""
    return F.filter(F.split(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), SEPARATORS), lambda w: w != "")


def grams(all_words: Column) -> Column:
    """For each place with a next word: the hash of this pair, and of the pair with the pair after it."""
    n = F.size(all_words)
    rest = F.greatest(n - 1, F.lit(0))
    pairs = F.zip_with(F.slice(all_words, 1, rest), F.slice(all_words, 2, rest), lambda a, b: F.xxhash64(a, b))
    ahead = F.slice(pairs, 3, F.greatest(n, F.lit(1)))
    return F.zip_with(pairs, ahead, lambda a, b: F.struct(a.alias("pair"), F.xxhash64(a, b).alias("four")))


def template_places(spark: SparkSession) -> DataFrame:
    """A row for each pair of each template: (template, label, base, size, place, pair, four). A fixed, small table."""
    rows = [(i, t, label, i < len(BASE_PHRASES)) for i, (t, label) in enumerate(BASE_PHRASES + TEMPLATES)]
    return (
        spark.createDataFrame(rows, "template int, phrase string, label string, base boolean")
        .withColumn("all_words", words(F.col("phrase")))
        .select("template", "label", "base", F.size("all_words").alias("size"), F.posexplode(grams(F.col("all_words"))).alias("place", "g"))
        .select("template", "label", "base", "size", "place", F.col("g.pair").alias("pair"), F.when(~F.col("base"), F.col("g.four")).alias("four"))
        .where("base or place + 4 <= size")
    )


def scan(docs: DataFrame, *, max_shift: int = 3, min_coverage: float = 0.6) -> DataFrame:
    """License places of every row's whole text.

    Returns doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.
    Base phrases count at every place where their words stand consecutively. A longer
    template matches by runs of four words; diagonals at most max_shift apart are one
    span, which holds if at least min_coverage of the template's runs vote for it and
    it is no longer than one and a half times the template. score is 1 with a base
    phrase, else the best coverage (0 without any). Texts without words, null ones
    too, have no places: null first_word and last_word, empty labels. Rows with equal
    doc_id and text get equal results; only doc_id and text are read.
    """
    keyed = docs.select(
        F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_text"), words(F.coalesce("text", F.lit(""))).alias("_words")
    )
    votes = (
        keyed.select("_id", "_text", F.posexplode(grams(F.col("_words"))).alias("_at", "_g"))
        .select("_id", "_text", "_at", F.col("_g.pair").alias("_pair"), F.col("_g.four").alias("_four"))
        .join(
            F.broadcast(template_places(docs.sparkSession)),  # a constant of this module
            (F.col("_pair") == F.col("pair")) & (F.col("base") | (F.col("_four") == F.col("four"))),
        )
        .groupBy("_id", "_text", "template", "label", "base", "size", (F.col("_at") - F.col("place")).alias("diagonal"), "place")
        .agg(F.min("_at").alias("at"))  # one vote a place, however often the row is repeated
    )
    diagonals = votes.groupBy("_id", "_text", "template", "label", "base", "size", "diagonal").agg(
        F.count("*").alias("votes"), F.min("at").alias("first"), F.max("at").alias("last")
    )
    by_template = Window.partitionBy("_id", "_text", "template").orderBy("diagonal")
    spans = (
        diagonals.withColumn("apart", F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by_template) > F.lit(max_shift), F.lit(True)))
        .withColumn("span", F.when(F.col("base"), F.col("diagonal")).otherwise(F.sum(F.col("apart").cast("int")).over(by_template)))
        .groupBy("_id", "_text", "template", "label", "base", "size", "span")
        .agg(F.sum("votes").alias("votes"), F.min("first").alias("first"), F.max("last").alias("last"))
        .withColumn("coverage", F.least(F.lit(1.0), F.col("votes") / (F.col("size") - F.when(F.col("base"), 1).otherwise(3))))
        .withColumn(
            "holds",
            F.when(F.col("base"), F.col("coverage") == 1.0).otherwise(
                (F.col("coverage") >= min_coverage) & (F.col("last") + 4 - F.col("first") <= 1.5 * F.col("size"))
            ),
        )
        .withColumn("place", F.when(F.col("base") & F.col("holds"), F.col("first")))
    )

    def joined(condition: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(F.when(condition, F.col("label")))), ",")

    found = spans.groupBy("_id", "_text").agg(
        F.count("place").alias("n_base"),
        F.min("place").cast("long").alias("first_word"),
        F.max("place").cast("long").alias("last_word"),
        joined(F.col("base") & F.col("holds")).alias("base_labels"),
        joined(F.col("holds")).alias("labels"),
        F.max(F.when(~F.col("base") | F.col("holds"), F.col("coverage"))).alias("score"),
    )
    rows = keyed.select(F.col("_id").alias("doc_id"), F.col("_text").alias("_key"), F.size("_words").cast("long").alias("n_words"))
    return rows.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_text")), "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"),
    )
