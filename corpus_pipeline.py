"""A training corpus from `documents`: languages, quality, near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns the rows it keeps with the columns of
docs; the last returns the packed pieces. docs is what the stage before has written.
Null and empty texts have no letter, so the first stage drops them; a stage by itself
takes them as its docstring says. An empty table passes through all stages as one, and
further columns are handed on untouched. Texts are taken whole, however long.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import jaccard_join, language_id, packing, quality_classifier, suffix_dedup
from weftgraph.llm.common import checkpoint, held_out, restored, stored, table

MIN_LANGUAGE_SHARE = 0.5
MIN_QUALITY = 0.3


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows without a letter (null and empty texts too), and those without a language for at least half of their letters; repeated rows fare alike."""
    model = language_id.fit(docs, ~held_out(F.col("doc_id"), 4, 2))
    named = language_id.identify(docs, model, carry=[c for c in docs.columns if c != "text"])
    return restored(named.where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= MIN_LANGUAGE_SHARE)), docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows whose quality score is below the threshold; a null text scores as an empty one, repeated rows fare alike."""
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"), 5, 0))
    model = quality_classifier.fit(docs, labels)
    scored = quality_classifier.score(docs, model, threshold=MIN_QUALITY, carry=[c for c in docs.columns if c != "text"])
    return restored(scored.where("predicted = 1"), docs.columns)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class of near copies, the one with the least doc_id, then the least key of its text.

    A row without words (null and empty texts too) is no copy of another, but of rows
    with the same doc_id and text one stays in any case.
    """
    linked = jaccard_join.link(docs)
    first = F.min(F.struct("doc_id", "text_key")).alias("first")
    stay = linked.where("class_key is not null").groupBy("class_key").agg(first).select("first.*")
    stay = stay.unionByName(linked.where("class_key is null").select("doc_id", "text_key"))
    # Join and repeats by the same columns, so that the rows are dealt out once; a struct of a null id equals another.
    stay = stay.select(F.struct("doc_id").alias("id"), "text_key")
    rows = docs.select(F.struct("doc_id").alias("id"), F.xxhash64("text").alias("text_key"), F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    return rows.join(stay, ["id", "text_key"], "left_semi").dropDuplicates(["id", "text_key"]).select("row.*")


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts 200-byte strings that occur more than once; half characters at a cut go too, n_chars follows the text.

    Every row stays, if with an empty text: repeated rows lose all they share, null counts as empty.
    """
    others = [c for c in docs.columns if c != "text"]
    text = F.regexp_replace(F.make_valid_utf8(F.col("kept").cast("string")), "�", "")
    cut = suffix_dedup.remove_repeats(docs, carry=others).select("row.*", F.when(F.col("n_removed") > 0, text).otherwise(F.col("kept").cast("string")).alias("text"))
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in others else cut.select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs every row's tokens into sequences of 4096; a null or empty text is its end token, repeated rows have pieces each."""
    pieces = packing.tokenize(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(checkpoint(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))))


STAGES = [
    ("language_id", language_stage),
    ("quality_classifier", quality_stage),
    ("jaccard_join", near_copy_stage),
    ("suffix_dedup", passage_stage),
    ("packing", packing_stage),
]

# Fitted models, compressors and tokenizers are not SQL; tests compare the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is written before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
